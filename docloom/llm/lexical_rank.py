"""Ranked lexical search by norm buckets: Cauchy-Schwarz between buckets, coordinate bounds inside."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from docloom.llm.common import slices, texts_of, written

# Bytes of the terms of one block of items; a block's terms and weights are what tasks receive.
BLOCK_BYTES = 16 << 20
# Documents of the greatest norms that set the first thresholds, rows and ratio of norms of a bucket.
SEEDS, BUCKET_ROWS, LEAST_ROWS, BUCKET_RATIO = 20_000, 8_192, 512, 0.8
# Bytes of a text that are cut into terms at a time.
PART = 4 << 20
# Rounding of norms and bounds; a row is only passed over below this much of the threshold.
SLACK = 1 - 1e-9


def _table() -> bytes:
    """Every byte's class: digits, letters (A-Z lower-cased) and bytes past ASCII stay, the others are spaces."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    table[48:58] = range(48, 58)
    table[97:123] = range(97, 123)
    table[65:91] = range(97, 123)
    return bytes(table)


_BYTES = _table()


def _parts(text: str) -> Iterator[list[bytes]]:
    """The text's terms in order, some at a time."""
    data, start = text.encode("utf-8", "surrogatepass").translate(_BYTES), 0
    while len(data) - start > PART:
        end = data.rfind(b" ", start, start + PART) + 1 or data.find(b" ", start + PART) + 1 or len(data)
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, term (binary) and q, its occurrences in all different texts of the item."""
    own = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    schema = StructType([own.schema["item"], StructField("term", BinaryType()), StructField("q", LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, terms, many = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = Counter(t for part in _parts(text) for t in part)
                row += [k] * len(found)
                terms += found.keys()
                many += found.values()
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row, pa.int64())), pa.array(terms, pa.binary()), pa.array(many, pa.int64())], names=["item", "term", "q"])

    return own.mapInArrow(run, schema).groupBy("item", "term").agg(F.sum("q").alias("q"))


def _blocks(terms: DataFrame) -> Iterator[list]:
    """The items' rows (item, term, q) in blocks whose terms stay below BLOCK_BYTES; a larger item is a block of its own."""
    size = F.sum(F.octet_length("term") + 24)
    total = terms.agg(size).first()[0]
    if total is None:
        return
    many = -(-2 * total // BLOCK_BYTES)
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(many))
        sizes = terms.groupBy(block.alias("block")).agg(size.alias("size"), F.count_distinct(F.struct("item")).alias("n")).collect()
        if all(r["size"] <= BLOCK_BYTES or r["n"] == 1 for r in sizes):
            break
        many *= 2
    for number in sorted(r["block"] for r in sizes):
        yield terms.where(block == number).collect()


class Items:
    """A block's items: numbered terms and, per item, the terms' numbers and repeats."""

    def __init__(self, rows: list):
        self.values, self.vocabulary, own = [], {}, {}
        for r in rows:
            own.setdefault(r["item"], []).append((self.vocabulary.setdefault(bytes(r["term"]), len(self.vocabulary)), r["q"]))
        self.terms, self.repeats = [], []
        for value, pairs in own.items():
            self.values.append(value)
            self.terms.append(np.array([t for t, _ in pairs], np.int64))
            self.repeats.append(np.array([q for _, q in pairs], np.int64))
        self.norms = [math.sqrt(float((q.astype(np.float64) ** 2).sum())) for q in self.repeats]


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n, and the numbers (32 bits) and frequencies (64 bits) of the block's terms, of every document with a term."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"], StructField("n", LongType()), StructField("terms", BinaryType()), StructField("tfs", BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (s for b in batches for s in slices(b, "text")):
            kept, sizes, terms, tfs = [], [], [], []
            for k, text in enumerate(texts_of(batch, "text").to_pylist()):
                n, found = 0, Counter()
                for part in _parts(text):
                    n += len(part)
                    found.update(filter(None.__ne__, map(known.get, part)))
                if n:
                    kept.append(k)
                    sizes.append(n)
                    terms.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                    tfs.append(np.fromiter(found.values(), "<i8", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                                              pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, schema)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column in order, and how many each row has."""
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), pc.binary_length(column).to_numpy(zero_copy_only=False) // width


def _weights(vectors: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """floor(1000 ln((2N+2)/(2df+1))) of every term, N and L."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_flat(batch.column("terms"), "<i4")[0], minlength=terms)
            docs, words = docs + batch.num_rows, words + pc.sum(batch.column("n")).as_py() if batch.num_rows else words
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], seen))), pa.array(np.concatenate(([docs, words], df[seen])))], names=["term", "df"])

    sums = {r["term"]: r["df"] for r in vectors.select("n", "terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    total, words = sums.pop(-2, 0), sums.pop(-1, 0)
    df = np.zeros(terms, np.int64)
    df[list(sums)] = list(sums.values())
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64), total, words


def _impacts(vectors: DataFrame, weights: np.ndarray, total: int, words: int) -> DataFrame:
    """id, norm, terms and impacts (64 bits) of every document that holds a term of weight."""
    schema = StructType([vectors.schema["id"], StructField("norm", DoubleType()), StructField("terms", BinaryType()), StructField("impacts", BinaryType())])
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, each = _flat(batch.column("terms"), "<i4")
            tfs = _flat(batch.column("tfs"), "<i8")[0]
            m = np.array([100 - 75 + 75 * n * total // words for n in batch.column("n").to_pylist()], np.int64)
            own = shared.value[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, each)))
            cuts = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
            row = np.repeat(np.arange(len(each)), each)
            norms = np.sqrt(np.bincount(row, own.astype(np.float64) ** 2, len(each)))
            data = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(cuts * 8), pa.py_buffer(own.astype("<i8").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norms), batch.column("terms"), data], names=["id", "norm", "terms", "impacts"])

    return vectors.mapInArrow(run, schema).where("norm > 0")


class Bucket:
    """Vectors of similar norms: by row, and by term for the terms' coordinates."""

    def __init__(self, batch: pa.Table, vocabulary: int):
        batch = batch.combine_chunks()
        self.ids = batch.column("id").combine_chunks()
        self.norms = batch.column("norm").to_numpy()
        self.terms, self.each = _flat(batch.column("terms").combine_chunks(), "<i4")
        self.impacts = _flat(batch.column("impacts").combine_chunks(), "<i8")[0]
        self.ends = np.cumsum(self.each)
        order = np.argsort(self.terms, kind="stable")
        self.rows = np.repeat(np.arange(len(self.each)), self.each)[order]
        self.values = self.impacts[order]
        self.starts = np.searchsorted(self.terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.values, self.starts[held])
        place = np.empty(len(self.ids), np.int64)
        place[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.ids))
        self.place = place

    def search(self, terms: np.ndarray, repeats: np.ndarray, norm: float, least: int, k: int, vocabulary: int) -> list[tuple]:
        """(score, id) of the ``k`` best rows of score ``least`` or more, equal scores by rising id.

        The terms that weigh most in the bucket are its focus: enough of them that the others
        alone cannot reach ``least``.  A row stays if the focus part of its score, and the most
        that the rest can add (its length outside the focus, or the largest coordinates), do.
        """
        if norm * self.norms[0] < least * SLACK:
            return []
        most = repeats * self.most[terms]
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        rest = np.cumsum(most[order][::-1])[::-1]
        focus, others = order[rest >= least], order[rest < least]
        if not len(focus):
            return []
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms[focus]]
        rows = np.concatenate([self.rows[s] for s in spans])
        own = np.concatenate([self.values[s] for s in spans]).astype(np.float64)
        factor = np.repeat(repeats[focus].astype(np.float64), [s.stop - s.start for s in spans])
        part = np.bincount(rows, own * factor, len(self.norms))
        if len(others):
            left = np.sqrt(np.maximum(self.norms**2 * (2 - SLACK) - np.bincount(rows, own**2, len(self.norms)), 0))
            part = part + np.minimum(left * math.sqrt(float((repeats[others].astype(np.float64) ** 2).sum())), float(rest[len(focus)]))
        near = np.flatnonzero((part >= least * SLACK) & (part > 0))
        if not len(near):
            return []
        # Exact scores of the survivors over all their terms.
        each, ends = self.each[near], np.cumsum(self.each[near])
        at = np.arange(ends[-1]) + np.repeat(self.ends[near] - ends, each)
        query = np.zeros(vocabulary, np.int64)
        query[terms] = repeats
        sums = np.concatenate(([0], np.cumsum(query[self.terms[at]] * self.impacts[at])))
        scores = sums[ends] - sums[ends - each]
        good = np.flatnonzero(scores >= least)
        best = good[np.lexsort((self.place[near[good]], -scores[good]))[:k]]
        return list(zip(scores[best].tolist(), self.ids.take(pa.array(near[best])).to_pylist()))


def _buckets(batches: Iterable[pa.RecordBatch], vocabulary: int) -> Iterator[Bucket]:
    """The task's rows, which come by falling norm, in buckets."""
    held, rows, top = [], 0, None
    for batch in batches:
        start, norms = 0, batch.column("norm").to_numpy()
        while start < len(norms):
            if top is None:
                top = norms[start]
            # Up to LEAST_ROWS whatever the norm; then as long as it is near the top's.
            fits = start + int(np.argmax(norms[start:] < top * BUCKET_RATIO)) if norms[-1] < top * BUCKET_RATIO else len(norms)
            end = min(len(norms), start + BUCKET_ROWS - rows, max(fits, start + LEAST_ROWS - rows))
            if end > start:
                held.append(batch.slice(start, end - start))
                rows += end - start
            if end < len(norms) or rows >= BUCKET_ROWS:
                yield Bucket(pa.Table.from_batches(held), vocabulary)
                held, rows, top = [], 0, None
            start = max(end, start)
    if held:
        yield Bucket(pa.Table.from_batches(held), vocabulary)


def _best(vectors: DataFrame, items: Items, least: list[int], k: int) -> DataFrame:
    """item (number), id, score and rank of each item's ``k`` best rows with a score of ``least`` or more."""
    schema = StructType([StructField("item", IntegerType()), vectors.schema["id"], StructField("score", LongType())])
    shared = vectors.sparkSession.sparkContext.broadcast((items.terms, items.repeats, items.norms, least, len(items.vocabulary)))
    rank = lambda row: (-row[0], row[1] is not None, row[1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, repeats, norms, bound, vocabulary = shared.value
        bound, held, kind = list(bound), [[] for _ in terms], None
        for bucket in _buckets(batches, vocabulary):
            kind = bucket.ids.type
            for k_item in range(len(terms)):
                found = bucket.search(terms[k_item], repeats[k_item], norms[k_item], bound[k_item], k, vocabulary)
                if found:
                    held[k_item] = sorted(held[k_item] + found, key=rank)[:k]
                    if len(held[k_item]) == k:
                        bound[k_item] = max(bound[k_item], held[k_item][-1][0])
        if kind is not None:
            for k_item in range(0, len(terms), 1000):
                part = [(i, d, s) for i in range(k_item, min(k_item + 1000, len(terms))) for s, d in held[i]]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], kind),
                                                  pa.array([p[2] for p in part], pa.int64())], names=["item", "id", "score"])

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return vectors.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame | None:
    vectors = written(_vectors(docs, items.vocabulary, id_col, text_col), "search-vectors")
    weights, total, words = _weights(vectors, len(items.vocabulary))
    if not total:
        return None
    # Ordered by norm; the id deals equal norms, as copies have them, to several tasks.
    ordered = _impacts(vectors, weights, total, words).repartitionByRange(F.desc("norm"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm"))
    ordered = written(ordered, "search-buckets")
    cut = ordered.agg(F.percentile_approx("norm", F.lit(max(0.0, 1 - SEEDS / total)), F.lit(10_000))).first()[0]
    if cut is None:
        return None
    seeds = _best(ordered.where(F.col("norm") >= cut), items, [1] * len(items.values), k)
    least = [1] * len(items.values)
    for r in seeds.where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    # No vector below this norm reaches any item's threshold.
    floor = min(t / n for t, n in zip(least, items.norms)) * SLACK
    return _best(ordered.where(F.col("norm") >= floor), items, least, k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``k`` highest-scoring documents: item column, rank (from 1), id column, score.

    Terms are runs of digits, letters and characters past ASCII, A-Z lower-cased.  A
    document's impact of a term is w * ((1000000000 tf) div (1000 tf + 8 m)) with
    w = floor(1000 ln((2N+2)/(2df+1))) and m = 25 + (75 n N) div L; its score sums the
    impacts of the item's terms, repeats included.  Rows of score 0 are left out; equal scores
    go by rising id, null ids first.

    Impact vectors over the items' terms are ordered by norm.  The documents of the
    greatest norms give every item a first threshold; then norms below threshold / |item| are
    not read, buckets are passed over by Cauchy-Schwarz, and bounds on coordinates filter
    inside them.  Survivors are scored in 64-bit integers.  Bounds only pass over rows below a
    reached threshold, so the result is exact.

    Items are searched in blocks of bounded size, against all documents each.  Null and empty
    texts have no terms; items without terms, or an empty table, give no rows.  Different
    texts of one item count as one text; repeated item rows count once, repeated document
    rows each rank.  Other columns are ignored.
    """
    spark, found = docs.sparkSession, None
    terms = written(_item_terms(items, item_col, item_text), "search-items")
    item_type, id_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    out = StructType([StructField("item", IntegerType()), StructField("item_value", item_type)])
    for rows in _blocks(terms):
        block = Items(rows)
        best = _search_block(spark, docs, block, k, id_col, text_col)
        if best is None:
            continue
        names = spark.createDataFrame(list(enumerate(block.values)), out)
        best = best.join(F.broadcast(names), "item").select(F.col("item_value").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], StructType([StructField(item_col, item_type), StructField("rank", IntegerType()), StructField(id_col, id_type), StructField("score", LongType())]))
    return found
