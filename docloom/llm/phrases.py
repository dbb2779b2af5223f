"""Phrase collocations: an FM-index over word ids per shard, n-gram counts summed across shards."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written

# Text bytes of one shard's indexes; a longer text is cut between pieces, never inside one.
SHARD_BYTES = 16 << 20
# Bits of the filter that tells shards which words can be in a candidate (4 MB, whatever the corpus).
FILTER_BITS = 25
ROWS = 1 << 19
# Parts of a language that are ranked apart first.
PARTS = 16


def _table() -> bytes:
    """Every byte's class: A-Z lower-cased, piece separators as line feeds, tabs as spaces."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = 10
    table[9] = 32
    return bytes(table)


_BYTES = _table()


class Shard:
    """Words of some texts of one language, and the index over their ids.

    ``text`` holds ids from 1, with 0 between pieces.  The rows of the index are the text's
    positions ordered by the three words from there; ``bwt`` is the word before each row,
    and ``step``, its stable order, leads from a row to the row one word to the right.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        gap = (data == 32) | (data == 10)
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
        begins, ends = edge[::2], edge[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - begins)))
        letters = pa.py_buffer(data[~gap].tobytes())
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        self.words: list[bytes] = words.dictionary.to_pylist()
        ids = words.indices.to_numpy().astype(np.int64) + 1
        self.counts = np.bincount(ids, minlength=len(self.words) + 1)[1:]
        piece = np.searchsorted(np.flatnonzero(data == 10), begins)
        # A piece's first word comes after a separator, and one ends the text.
        first = np.diff(piece, prepend=-1) != 0
        self.text = np.zeros(len(ids) + int(first.sum()) + 1, np.int64)
        self.text[np.arange(len(ids)) + np.cumsum(first)] = ids

    def intervals(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Three-word intervals of the index: the words' ids (0: a piece's end), size, and number of the two-word interval.

        Level by level: an interval of one more word to the left is what the rows of an
        interval with one word before them become after the step to that word, so a row
        starts a new interval where its word or the interval one word to its right changes.
        """
        text = self.text
        size = len(text)
        if not len(self.words):
            return
        after, second = np.roll(text, -1), np.roll(text, -2)
        if len(self.words) < 1 << 21:
            rows = np.argsort(text << 42 | after << 21 | second)
        else:
            rows = np.lexsort((second, after, text))
        bwt = text[rows - 1]
        step = np.argsort(bwt, kind="stable")
        first = bwt[step]
        del rows, after, second, bwt
        numbers = np.cumsum(np.diff(first, prepend=-1) != 0)
        levels = []
        for _ in range(2):
            right = numbers[step]
            starts = (np.diff(first, prepend=-1) != 0) | (np.diff(right, prepend=-1) != 0)
            numbers = np.cumsum(starts)
            levels.append(numbers)
        starts = np.flatnonzero(starts)
        two = first[step[starts]]
        yield first[starts], two, first[step[step[starts]]], np.diff(starts, append=size), levels[0][starts]


def _ids(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """A word's 64-bit id within its language, never 0."""
    salt = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    own = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in words), np.uint64, len(words))
    return np.maximum(own, np.uint64(1)).view(np.int64)


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at piece separators."""
    start = 0
    while len(text) - start > SHARD_BYTES:
        end = text.rfind(b"\n", start, start + SHARD_BYTES) + 1 or text.find(b"\n", start + SHARD_BYTES) + 1 or len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """The task's rows (lang, text) as shards of about SHARD_BYTES, each of one language."""
    held, total = defaultdict(list), 0

    def release() -> Iterator[tuple[str, Shard]]:
        for lang in list(held):
            yield lang, Shard(held.pop(lang))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for part in _cut(text.encode("utf-8", "surrogatepass").translate(_BYTES)):
                held[lang].append(part)
                total += len(part)
                if total >= SHARD_BYTES:
                    yield from release()
                    total = 0
    yield from release()


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """id, lang, word and f (occurrences) of every word; rows of different words may share an id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            ids, size = _ids(shard.words, lang, seed), len(shard.words)
            for k in range(0, size, ROWS):
                part = slice(k, min(k + ROWS, size))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[part]), pa.array([lang] * (part.stop - k), pa.string()),
                    pa.array(shard.words[part], pa.binary()).cast(pa.string()), pa.array(shard.counts[part])], names=["id", "lang", "word", "f"])

    return texts.mapInArrow(run, "id long, lang string, word string, f long").groupBy("id", "lang", "word").agg(F.sum("f").alias("f"))


def _filter(words: DataFrame, least: int) -> np.ndarray:
    """A bit for the last FILTER_BITS bits of each frequent word's id, as 64-bit words."""
    slot = F.col("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = words.where(F.col("f") >= least).groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out


def _windows(texts: DataFrame, seed: int, frequent: np.ndarray) -> DataFrame:
    """w1, w2, w3 and f of each shard's three-word windows whose first two words can be frequent.

    w3 is 0 where the piece ends or the third word is rare, so that f over all w3 is that of
    the two words.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            ids = np.concatenate(([0], _ids(shard.words, lang, seed)))
            slot = ids & (1 << FILTER_BITS) - 1
            keep = (shared.value[slot >> 6] >> (slot & 63) & 1).astype(bool)
            keep[0] = False
            for one, two, three, size, pair in shard.intervals():
                own = keep[one] & keep[two]
                whole = own & keep[three]
                # What a pair's intervals with an end or a rare word hold together.
                cut = own & ~whole
                heads = np.flatnonzero(cut)
                ends = heads[np.diff(pair[heads], prepend=-1) != 0]
                rest = np.add.reduceat(size[heads], np.searchsorted(heads, ends)) if len(ends) else np.zeros(0, np.int64)
                parts = [np.concatenate(x) for x in (
                    (ids[one[whole]], ids[one[ends]]), (ids[two[whole]], ids[two[ends]]),
                    (ids[three[whole]], np.zeros(len(ends), np.int64)), (size[whole], rest))]
                for k in range(0, len(parts[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(p[k:k + ROWS]) for p in parts], names=["w1", "w2", "w3", "f"])

    return texts.mapInArrow(run, "w1 long, w2 long, w3 long, f long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits; at most a million."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at spaces and
    tabs into words.  n counts all words of a language, a the phrase's occurrences inside
    pieces; phrases of a >= ``least`` are candidates.  l and r are the counts of the two
    parts at the cut with the lowest score floor(1000000 a a / (l r)), the first of equal
    ones.  A two-word candidate inside a three-word one with 100 f >= ``share`` a is dropped.
    Order: score and a falling, phrase rising by bytes.

    Each task indexes its texts in shards (one FM-index per language and SHARD_BYTES) and
    emits every interval's count once, so copies inside a shard cost nothing more; a word
    that is rare in the whole corpus ends a window early, as no candidate can hold it.  Ids
    are 64-bit hashes, checked against the word table; on a collision all starts again with
    another seed, so counts are exact.  Null languages count as ``und``; null and empty
    texts have no words; an empty table, or one without candidates, gives no rows; other
    columns are ignored.  Memory follows the shard size or the longest piece.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seed = 0
    while True:
        words = written(_word_counts(texts, seed), "phrase-words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.where(F.col("f") >= least)
    windows = _windows(texts, seed, _filter(words, least)).repartition("w1", "w2")
    pair = Window.partitionBy("w1", "w2")
    summed = windows.groupBy("w1", "w2", "w3").agg(F.sum("f").alias("f"))
    # A pair's row of the smallest third word stands for the pair.
    counted = summed.withColumn("a2", F.sum("f").over(pair)).withColumn("head", F.col("w3") == F.min("w3").over(pair))
    grams = written(counted.where((F.col("a2") >= least) & (F.col("head") | (F.col("f") >= least))), "phrase-counts")
    twos = grams.where("head").select("w1", "w2", F.col("a2").alias("a"))
    threes = grams.where((F.col("w3") != 0) & (F.col("f") >= least)).select("w1", "w2", "w3", F.col("f").alias("a"), F.col("a2").alias("left2"))
    longest = threes.select("w1", "w2", "a").union(threes.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    twos = twos.join(longest, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    threes = threes.join(grams.where("head").select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a2").alias("right2")), ["w2", "w3"])
    whole = twos.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.lit(None).cast("long").alias("left2"), F.lit(None).cast("long").alias("right2")).union(
        threes.select("w1", "w2", "w3", "a", "left2", "right2"))
    for k in (1, 2, 3):
        own = known.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
        whole = whole.join(own, f"w{k}", "left" if k == 3 else "inner")
    # Two words are cut once; three after the first or the second.
    late = F.col("w3").isNotNull() & (_score(F.col("a"), F.col("left2"), F.col("f3")) < _score(F.col("a"), F.col("f1"), F.col("right2")))
    scored = whole.join(totals, "lang").select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(late, F.col("left2")).otherwise(F.col("f1")).alias("l"),
        F.when(late, F.col("f3")).when(F.col("w3").isNotNull(), F.col("right2")).otherwise(F.col("f2")).alias("r"), "n",
    ).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    # First within parts of a language, so that one task ranks at most PARTS * top of its phrases.
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
