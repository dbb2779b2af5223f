"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import once, written

# Words of a shingle, least similarity.
SHINGLE, SIMILARITY = 5, 0.8
# Fingerprints within RADIUS bits are candidates.  Of BLOCKS blocks one then differs in at most
# NEAR bits, so an index of blocks with all their variants of NEAR bits misses none.
RADIUS, BLOCKS = 23, 8
NEAR = RADIUS // BLOCKS
# Benchmark anchors up to this count are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_ANCHORS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def runs(words: Column, size: int) -> Column:
    """XXH64 of every run of ``size`` neighbouring words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda k: F.xxhash64(F.slice(words, k, size)))
                  ).otherwise(F.array().cast("array<long>"))


def shingles(words: Column, size: int) -> Column:
    """Every run of ``size`` words as text; all words if there are fewer."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda k: F.array_join(F.slice(words, k, size), " "))


def simhash(words: Column) -> Column:
    """Bit by bit the majority over the XXH64 of the words, repeats weighing as often as they occur."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def fold(own: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(
            2 * F.size(F.filter(own, lambda h: F.call_function("getbit", h, b) == 1)) > F.size(own), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))

    return once(hashes, fold)


def weighted_similarity(left: Column, right: Column) -> Column:
    """Sum of the smaller over sum of the larger multiplicities of two shingle lists."""
    count = lambda of, s: F.size(F.filter(of, lambda x: x == s))
    plain = (F.size(F.array_distinct(left)) == F.size(left)) & (F.size(F.array_distinct(right)) == F.size(right))
    # Only lists with repeats need to be counted shingle by shingle.
    shared = F.when(plain, F.size(F.array_intersect(left, right))).otherwise(
        F.aggregate(F.array_distinct(F.array_intersect(left, right)), F.lit(0), lambda acc, s: acc + F.least(count(left, s), count(right, s))))
    return shared / (F.size(left) + F.size(right) - shared)


def _block(fingerprint: Column, number: int) -> Column:
    """One of the fingerprint's BLOCKS blocks, behind the block's number."""
    width = 64 // BLOCKS
    return F.shiftrightunsigned(fingerprint, number * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int").bitwiseOR(F.lit(number << width))


def blocks(fingerprint: Column) -> Column:
    return F.array(*(_block(fingerprint, k) for k in range(BLOCKS)))


def block_index(items: DataFrame) -> DataFrame:
    """number and every block value within NEAR bits of a block of the item's fingerprint."""
    width = 64 // BLOCKS
    flips = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(width), n)]
    near = F.flatten(F.transform(blocks(F.col("item_fp")), lambda b: F.transform(F.array(*map(F.lit, flips)), lambda f: b.bitwiseXOR(f))))
    return items.select("number", F.explode(near).alias("block"))


def _hits(docs: DataFrame, items: DataFrame, text_col: str, shingle: int) -> DataFrame | None:
    """text_key, number, n_words, n, size, start and shared: places where a text holds a shingle of an item.

    start is where the item would begin; shared counts the hits there, over all copies of the
    text.  Positions of a shingle in items are joined, not the items.
    """
    sizes = sorted(r[0] for r in items.select(F.least("n_words", F.lit(shingle))).distinct().collect())  # at most ``shingle`` values
    tokens = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    hits = None
    for size in sizes:
        mine = items.where(F.least("n_words", F.lit(shingle)) == size)
        anchors = mine.select("number", "n_words", F.posexplode(runs(F.col("item_words"), size)).alias("at", "anchor")).distinct()
        if anchors.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS:
            anchors = F.broadcast(anchors)
        places = tokens.select("text_key", F.size("words").alias("n"), F.posexplode(runs(F.col("words"), size)).alias("pos", "anchor"))
        found = places.join(anchors, "anchor").select("text_key", "number", "n_words", "n", F.lit(size).alias("size"), (F.col("pos") - F.col("at")).alias("start"))
        found = found.groupBy("text_key", "number", "n_words", "n", "size", "start").agg(F.count("*").alias("shared"))
        hits = found if hits is None else hits.union(found)
    return hits


def _laid(hits: DataFrame, copies: DataFrame, similarity: float) -> DataFrame:
    """text_key, number, start: windows whose surroundings share enough shingles with the item.

    Shingles that a window shares begin inside it, so their hits lie less than n_words before
    or after its start: in its stretch of n_words starts or the ones beside it.  A window of
    the similarity shares so many that (1 + similarity) * shared >= similarity * (shingles of
    both).  Copies count each hit once more, so their number multiplies the right side.
    """
    keys = ["text_key", "number", "n_words", "n", "size"]
    stretch = F.floor(F.col("start") / F.col("n_words")).alias("stretch")
    sums = hits.groupBy(*keys, stretch).agg(F.sum("shared").alias("shared"))
    around = sums.select(*keys, "shared", F.explode(F.array(*(F.col("stretch") + d for d in (-1, 0, 1)))).alias("stretch")).groupBy(*keys, "stretch").agg(F.sum("shared").alias("shared"))
    both = F.col("n_words") + F.least("n_words", "n") - 2 * F.col("size") + 2
    dense = around.join(copies, "text_key").where((1 + similarity) * F.col("shared") >= (similarity * both - 1e-6) * F.col("copies")).select("text_key", "number", "stretch")
    placed = hits.select("text_key", "number", stretch, "start", "n", "n_words").join(dense, ["text_key", "number", "stretch"])
    # At a text's border the window is moved inside, as far as the text is long enough.
    return placed.select("text_key", "number", F.greatest(F.lit(0), F.least("start", F.col("n") - F.col("n_words"))).alias("start")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
            shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The best window of each (text, item) pair of at least ``similarity``: text_key, item, start, n_words, hamming, similarity.

    text_key is the XXH64 of the document's text, so copies are examined once.  Only a window
    that shares a shingle with an item can be similar to it, so windows are laid where a
    shared shingle puts an item of that length, unless its surroundings share too few.  A
    window goes on if a block of its SimHash over words is in the multi-index of the item's
    blocks and the fingerprints differ in RADIUS bits at most; the index is complete for the
    radius.  The exact similarity of shingle multisets then decides.  Over windows cut or
    replaced at an end or in the middle down to the similarity of 0.8 exactly, items of 17 to
    100 words, every fingerprint of over 20,000 lay within the radius (11 bits: 92 to 99 %).

    Null and empty texts and items have no windows; equal items each match; of equal windows
    the first counts; null item ids are kept.  Items shorter than a shingle are one shingle.
    Empty tables give no rows.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0)
    # The number stands for an item's words in joins: equal items share it, null ids have one.
    items = items.select("item", "item_words", F.size("item_words").alias("n_words"), F.xxhash64("item_words").alias("number"))
    hits = _hits(docs, items, text_col, shingle)
    if hits is None:
        return items.limit(0).select(F.lit(0).cast("long").alias("text_key"), "item", F.lit(0).alias("start"), "n_words", F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity"))
    hits = written(hits, "benchmark-hits")
    keys = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("text_key"))
    copies = keys.join(hits.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.count("*").alias("copies"))
    laid = written(_laid(hits, copies, similarity), "benchmark-windows")
    known = written(items.dropDuplicates(["number"]).select(
        "number", "n_words", simhash(F.col("item_words")).alias("item_fp"), shingles(F.col("item_words"), shingle).alias("item_shingles")), "benchmark-items")
    # One row of each text: copies inside a task fold before they move.
    wanted = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).join(
        laid.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", words_of(F.col("text")).alias("words"))
    windows = wanted.join(laid, "text_key").join(known.select("number", "n_words", "item_fp"), "number").select(
        "text_key", "number", "n_words", "item_fp", "start", F.slice("words", F.col("start") + 1, F.col("n_words")).alias("words"))
    windows = windows.withColumn("fp", simhash(F.col("words"))).withColumn("block", F.explode(blocks(F.col("fp"))))
    candidates = windows.join(block_index(known), ["number", "block"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= RADIUS)
    # A window that several blocks find is compared once.
    candidates = candidates.where(F.col("block") == _first_block()).join(known.select("number", "item_shingles"), "number")
    near = candidates.select("text_key", "number", "n_words", "start", "hamming",
                             weighted_similarity(shingles(F.col("words"), shingle), F.col("item_shingles")).alias("similarity")).where(F.col("similarity") >= similarity)
    best = near.groupBy("text_key", "number").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "hamming")).alias("best"))
    found = best.select("text_key", "number", (-F.col("best.back")).alias("start"), "best.n_words", "best.hamming", "best.similarity")
    return found.join(items.select("item", "number").distinct(), "number").select("text_key", "item", "start", "n_words", "hamming", "similarity")


def _first_block() -> Column:
    """The first block of the window that the item's index holds."""
    width = 64 // BLOCKS
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    out = F.lit(None).cast("int")
    for k in reversed(range(BLOCKS)):
        differs = F.bit_count(F.shiftrightunsigned(apart, k * width).bitwiseAND(F.lit((1 << width) - 1)))
        out = F.when(differs <= NEAR, _block(F.col("fp"), k)).otherwise(out)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document row and benchmark item that it holds: id column and the columns of ``matches``."""
    found = matches(docs, benchmark, text_col, **options)
    ids = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_key"))
    return ids.join(found, "text_key").drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, all their columns unchanged; null texts stay."""
    found = matches(docs, benchmark, text_col, **options).select("text_key").distinct()
    return docs.join(found, F.xxhash64(docs[text_col]) == found["text_key"], "left_anti")
