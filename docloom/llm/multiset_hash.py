"""Homomorphic multiset hashes of documents: wide vectors of paragraphs, summed modulo powers of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import once

# Lanes of 32 bits that tell paragraphs apart, and lanes of 16 bits that tell how alike texts are.
STRONG, LIKE = 8, 256
_LIKE_BITS = 16
# Rows of a range of ids that one task orders, ranges at most, and ranges of one step of the search for a row's range.
RANGE_ROWS, RANGES, FAN = 1_000, 1 << 15, 64


def _digests(units: Column) -> Column:
    return F.transform(units, lambda u: F.sha2(u.cast("binary"), 256))


def paragraphs(text: Column) -> Column:
    """Lines that are not empty; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts of paragraphs between full stops, exclamation and question marks that are not empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?\n]"), lambda s: s != "")


def lanes(text: Column) -> Column:
    """The text's hash: struct of ``strong`` and ``like``, arrays of longs.

    A paragraph's vector has STRONG lanes, the words of its SHA-256, and LIKE lanes, the sum over
    its sentences of +1 or -1 by each bit of the sentence's SHA-256.  The text's hash is the
    sum of its paragraphs' vectors, modulo 2^32 and 2^16.  Lanes are added up as 32-bit
    halves of longs, which no text is long enough to overflow.
    """
    def word(k: int):
        return lambda digest: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def strong(digests: Column) -> Column:
        return F.array(*(total(F.transform(digests, word(k))) % (1 << 32) for k in range(STRONG)))

    # Bit p of two of a digest's words at once.
    both = F.lit((1 << 32) | 1).cast("long")

    def bits(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda p: F.aggregate(
            words, F.lit(0).cast("long"), lambda acc, w: acc + F.call_function("shiftrightunsigned", w, p).bitwiseAND(both)))

    def two(k: int):
        return lambda digest: F.shiftleft(word(k + 1)(digest), 32).bitwiseOR(word(k)(digest))

    def like(digests: Column) -> Column:
        count = F.size(digests).cast("long")
        pairs = [once(F.transform(digests, two(k)), bits) for k in range(0, 8, 2)]
        halves = []
        for pair in pairs:
            halves += [F.transform(pair, lambda s: s.bitwiseAND(F.lit((1 << 32) - 1))), F.transform(pair, lambda s: F.shiftright(s, 32))]
        return F.transform(F.concat(*halves), lambda ones: F.pmod(2 * ones - count, F.lit(1 << _LIKE_BITS)))

    return F.struct(once(_digests(paragraphs(text)), strong).alias("strong"), once(_digests(sentences(text)), like).alias("like"))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The hash of a text after the paragraphs of ``right`` are put in (or, with sign -1, taken out).

    The hash of a document whose paragraphs are those of two others is the sum of theirs, in
    any order; no text is read.  Paragraphs that are taken out must be there.
    """
    def add(name: str, power: int) -> Column:
        return F.zip_with(left[name], right[name], lambda a, b: F.pmod(a + sign * b, F.lit(1 << power))).alias(name)

    return F.struct(add("strong", 32), add("like", _LIKE_BITS))


def text_of(own: Column) -> Column:
    """The whole hash as lowercase hex digits: strong lanes of eight digits, then the others of four."""
    def digits(values: Column, width: int) -> Column:
        return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")

    return F.concat(digits(own["strong"], 8), digits(own["like"], _LIKE_BITS // 4))


def likeness(left: Column, right: Column) -> Column:
    """Share of sentences that two hashes' texts have in common, estimated from the hashes: 0 to 1.

    2 a.b / (a.a + b.b) over the signed lanes, whose expectation is Dice's coefficient of the
    sentence multisets; the standard error is about 1 / sqrt(LIKE).  Equal hashes give 1.
    """
    half = 1 << _LIKE_BITS - 1
    signed = lambda x: F.when(x >= half, x - (1 << _LIKE_BITS)).otherwise(x)
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)
    square = lambda values: total(F.transform(values, lambda x: signed(x) * signed(x)))
    shared = 2 * total(F.zip_with(left["like"], right["like"], lambda a, b: signed(a) * signed(b)))
    sizes = square(left["like"]) + square(right["like"])
    same = (left["strong"] == right["strong"]) & (left["like"] == right["like"])
    return F.when(same, 1.0).when(sizes == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared / sizes)))


def _range(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (rising) below the key, by a search of FAN bounds at a time; 0 for null."""
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    if len(bounds) <= FAN:
        return F.coalesce(below(F.array(*(F.lit(b).cast("long") for b in bounds))) if bounds else F.lit(0), F.lit(0))
    step = FAN if len(bounds) <= FAN * FAN else FAN * FAN
    groups = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    which = below(F.array(*(F.lit(g[-1]).cast("long") for g in groups[:-1])))
    inner = F.array(*(F.array(*(F.lit(b).cast("long") for b in g)) for g in groups))
    own = F.element_at(inner, which + 1)
    if step > FAN:
        fine = F.size(F.filter(F.sequence(F.lit(FAN), F.greatest(F.size(own), F.lit(FAN)), F.lit(FAN)), lambda e: F.coalesce(F.get(own, e - 1) < key, F.lit(False))))
        return F.coalesce(which * step + fine * FAN + below(F.slice(own, fine * FAN + 1, FAN)), F.lit(0))
    return F.coalesce(which * step + below(own), F.lit(0))


def with_next(rows: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """Rows with the columns ``names`` of the next row, by falling id, as ``next_<name>``; the last is followed by the first.

    Ids are numbers; rows of equal ids follow by the hash of all columns, null ids come last.
    Ids are cut into ranges of about RANGE_ROWS rows.  The first row of a range also goes to
    the range before it (that of the greatest id to the last), so each range is ordered by
    itself, in one shuffle and without a window over all rows.  Rows of one id share a task.
    """
    total = rows.count()
    many = min(RANGES, max(1, total // RANGE_ROWS))
    shares = [k / many for k in range(1, many)]
    cuts = rows.agg(F.percentile_approx(id_col, F.array(*map(F.lit, shares)), F.lit(20 * many))).first()[0] if shares else []
    where = _range(F.col(id_col), sorted({int(c) for c in cuts or []}))
    # The greatest id of each range that has rows; at most RANGES numbers.
    tops = sorted((r["range"], r["top"]) for r in rows.select(where.alias("range"), id_col).groupBy("range").agg(F.max(id_col).alias("top")).collect())
    known = [(k, t) for k, t in tops if t is not None]
    # A range's top row is also the end of the range above; that of all ids the end of the lowest.
    heads = [t for _, t in known]
    above = {t: known[(k + 1) % len(known)][0] for k, (_, t) in enumerate(known)}
    if not known:
        guest = F.lit(None).cast("int")
    elif len(heads) <= FAN:
        guest = F.element_at(F.create_map(*(x for t in heads for x in (F.lit(t).cast("long"), F.lit(above[t])))), F.col(id_col).cast("long"))
    else:
        place = _range(F.col(id_col), heads[:-1])
        guest = F.when(F.element_at(F.array(*(F.lit(t).cast("long") for t in heads)), place + 1) == F.col(id_col),
                       F.element_at(F.array(*(F.lit(above[t]) for t in heads)), place + 1))
    own = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    spots = F.array(F.struct(where.cast("int").alias("range"), F.lit(False).alias("guest")), F.struct(guest.cast("int").alias("range"), F.lit(True).alias("guest")))
    placed = own.withColumn("_spot", F.explode(F.filter(spots, lambda s: s["range"].isNotNull()))).withColumn("_range", F.col("_spot.range")).withColumn("_guest", F.col("_spot.guest")).drop("_spot")
    order = Window.partitionBy("_range").orderBy("_guest", F.col(id_col).desc_nulls_last(), "_tie")
    follow = placed.withColumn("_next", F.lead(F.struct(*names)).over(order))
    if not known:
        # Without any id the first of the null ones follows the last.
        follow = follow.withColumn("_next", F.coalesce("_next", F.first(F.struct(*names)).over(order)))
    return follow.where(~F.col("_guest")).select(*rows.columns, *(F.col(f"_next.{n}").alias(f"next_{n}") for n in names))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's hash, that of its edited text, and how alike they and the next row's are.

    Columns: id, text, n_chars, edited (the last floor(n_chars / 2) code points replaced by as
    many of the next row's first, or all), own, edited_own, next_own (hashes), near_edited,
    near_next.  The next row is that of the next smaller id, after the last the first.
    Null and empty texts have the hash of no paragraph, all zeros; equal texts have equal
    hashes wherever they are; repeated rows are kept; a single row is its own next; an empty
    table gives no rows; other columns are ignored.

    A row's hash is computed where it is read and moves with it in the one shuffle; the next
    row's hash comes with its text.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(id_col, "text", lanes(F.col("text")).alias("own"))
    rows = with_next(rows, id_col, ["text", "own"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = rows.withColumn("edited_own", lanes(F.col("edited")))
    return rows.select(id_col, "text", "n_chars", "edited", "own", "edited_own", F.col("next_own"),
                       likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
