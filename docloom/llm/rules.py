"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import ensure_checkpoint_dir

# Strata whose cutoffs the driver reads.
MAX_STRATA = 1_000
WORD = r"[^\x20\x09-\x0D]+"
# Fixed rule set: ratio column and its cutoffs from the most lenient to the strictest.  A text
# whose ratio is above the cutoff is rejected; infinity rejects nothing.
RULES = {
    "symbols_per_word": [4.0, 2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05],
    "duplicate_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeated_word_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "chars_per_word": [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 10.0],
}


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """id column, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text.

    A three-word window is known by the XXH64 of its words; only texts that have a repeated
    window sort theirs by (hash, position).  Covered words are then counted along the sorted
    positions, so a text costs n log n at most.  A null text has no words; ids and strata may
    be null or repeated.  A narrow pass: nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    base = docs.select(
        F.col(id_col), (F.lit(None).cast("string") if stratum is None else stratum).alias("stratum"),
        words.alias("_words"), lines.alias("_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
    )
    two = base.withColumn("_shifted", F.slice("_words", 2, 1 << 30)).withColumn("_twice", F.slice("_words", 3, 1 << 30))
    triples = F.zip_with("_words", F.zip_with("_shifted", "_twice", lambda b, c: F.when(c.isNotNull(), F.struct(b.alias("b"), c.alias("c")))),
                         lambda a, bc: F.when(bc.isNotNull(), F.xxhash64(a, bc["b"], bc["c"])))
    hashed = two.withColumn("_hashes", F.filter(triples, lambda h: h.isNotNull()))
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = hashed.withColumn("_sorted", F.when(repeated, F.sort_array(
        F.transform("_hashes", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))))
    # A window is repeated if its neighbour in hash order has the same hash.
    left = F.concat(F.array(F.lit(None).cast("long")), F.col("_sorted.h"))
    right = F.concat(F.slice(F.col("_sorted.h"), 2, 1 << 30), F.array(F.lit(None).cast("long")))
    flagged = placed.withColumn("_left", F.when(repeated, left)).withColumn("_right", F.when(repeated, right))
    marked = F.zip_with("_sorted", F.arrays_zip("_left", "_right"), lambda s, n: F.when(
        s.isNotNull() & (F.coalesce(s["h"] == n["_left"], F.lit(False)) | F.coalesce(s["h"] == n["_right"], F.lit(False))), s["k"]))
    spots = flagged.withColumn("_spots", F.sort_array(F.filter(marked, lambda k: k.isNotNull())))
    spread = F.aggregate("_spots", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("covered")),
                         lambda acc, k: F.struct(k.alias("last"), (acc["covered"] + F.least(F.lit(3), k - acc["last"])).alias("covered")),
                         lambda acc: acc["covered"])
    return spots.select(
        id_col, "stratum", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(spread, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The fixed base rule: too few words, or most of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The value that each rule compares with its cutoff; 0 for texts without words or lines."""
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(0.0)
    return {
        "symbols_per_word": per_word("n_symbols"),
        "duplicate_line_share": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0),
        "repeated_word_share": per_word("n_repeat_words"),
        "chars_per_word": per_word("word_chars"),
    }


def _log_factorial(x: Column) -> Column:
    """ln(x!) by the Stirling series of ln Gamma(x + 8) brought down seven steps; error under 1e-11."""
    z = x.cast("double") + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    product = F.lit(1.0)
    for k in range(1, 8):
        product = product * (x.cast("double") + k)
    return series - F.log(product)


def binomial_tail(n: Column, k: Column, risk: float, terms: int = 4096) -> Column:
    """P(Binomial(n, risk) <= k): the exact sum, downward from k.

    At least 0 and at most 1.  Beyond ``terms`` terms the rest is bounded from above by a
    geometric series, so a cutoff is never let through on a sum that is too small.  Above the
    mean it answers 1, as no test there can succeed.
    """
    nd, kd = n.cast("double"), k.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + kd * math.log(risk) + (nd - kd) * math.log1p(-risk))
    odds = (1 - risk) / risk
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(terms - 1)).cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (kd - j) / (nd - kd + j + 1) * odds).alias("term")),
        lambda acc: acc["sum"] + F.when(kd >= terms, acc["term"] / (1 - (kd - terms) / (nd - kd + terms + 1) * odds)).otherwise(0.0))
    return F.when(kd >= nd * risk, 1.0).otherwise(F.least(F.lit(1.0), first * summed))


def cutoffs(features: DataFrame, good: DataFrame, id_col: str = "doc_id", risk: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """The strictest certified cutoff of every stratum and rule: stratum, rule, cutoff, n_good, n_rejected.

    ``good`` holds the ids of labelled documents that should be kept; those that the base
    rule fails are not the cutoffs' to reject and stay out.  A cutoff is certified if,
    were its true rate of false rejection above ``risk`` / rules, so few rejections would
    have a probability of at most (1 - ``confidence``) / (strata x rules): the exact
    binomial (Clopper-Pearson) bound, with Bonferroni's correction across strata and rules.
    Within a rule, cutoffs are tried from lenient to strict and end at the first failure
    (fixed-sequence testing), which needs no further correction.  All rules together then
    reject at most ``risk`` of the good texts of a stratum, with ``confidence`` over all of
    them.  Every labelled row counts; sums are pre-aggregated before the shuffle.  A
    stratum without enough labelled rows has no rows here and rejects nothing.
    """
    held = features.join(good.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col).where(~base_failed())
    held = held.withColumn("stratum", F.coalesce("stratum", F.lit("")))
    values = ratios()
    tests = F.explode(F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.lit(place).alias("place"), F.lit(cut).alias("cutoff"), (values[rule] > cut).cast("long").alias("hit"))
        for rule, cuts in RULES.items() for place, cut in enumerate(cuts)))).alias("t")
    sums = held.select("stratum", tests).groupBy("stratum", "t.rule", "t.place", "t.cutoff").agg(
        F.count("*").alias("n_good"), F.sum("t.hit").alias("n_rejected"))
    strata = sums.select("stratum").distinct().agg(F.count("*").alias("n_strata")).withColumn("_one", F.lit(1))
    level = (1 - confidence) / (F.col("n_strata") * len(RULES))
    tested = sums.withColumn("_one", F.lit(1)).join(strata, "_one").withColumn(
        "passed", (binomial_tail(F.col("n_good"), F.col("n_rejected"), risk / len(RULES)) <= level).cast("int"))
    along = Window.partitionBy("stratum", "rule").orderBy("place")
    return (
        tested.withColumn("passed", F.min("passed").over(along)).where("passed = 1")
        .groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.max_by("n_good", "place").alias("n_good"),
                                        F.max_by("n_rejected", "place").alias("n_rejected"))
    )


def judge(features: DataFrame, certified: DataFrame) -> DataFrame:
    """Add base_failed and kept: a text passes if no certified rule of its stratum rejects it.

    The cutoffs are read once, as the small model that they are: at most MAX_STRATA strata,
    more raise ValueError.  Rows are then judged where they are, without a join.
    """
    rows = certified.limit(MAX_STRATA * len(RULES) + 1).collect()
    if len(rows) > MAX_STRATA * len(RULES):
        raise ValueError(f"more than {MAX_STRATA} strata")
    rejected = F.lit(False)
    for rule, value in ratios().items():
        own = [x for r in rows if r["rule"] == rule for x in (F.lit(r["stratum"]), F.lit(r["cutoff"]))]
        if own:
            cutoff = F.element_at(F.create_map(*own), F.coalesce("stratum", F.lit("")))
            rejected = rejected | F.coalesce(value > cutoff, F.lit(False))
    return features.select("*", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def screen(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None,
           risk: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """Counts, base rule and verdict of every document; see ``counts``, ``cutoffs`` and ``judge``.

    Texts are read once: their counts, some tens of bytes a document, are checkpointed and
    serve both the calibration and the verdict.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    features = counts(docs, id_col, text_col, stratum).checkpoint()
    return judge(features, cutoffs(features, good, id_col, risk, confidence))
