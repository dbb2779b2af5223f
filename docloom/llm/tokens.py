"""Exact token ids of whole texts, power-of-two packing, and the token length histogram."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import slices, texts_of

# Words whose ids a worker remembers.
CACHE_WORDS = 700_000
# Punctuation after a letter is a token group of its own for such tokenizers.
_TAIL = ".,;:!?#$%&*|"
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts for a lower-casing tokenizer that drops white space and splits letters
    from the rest, so that a text's ids are those of its words in order.

    Each distinct word is encoded once and remembered.  Words of letters alone are encoded
    many at a time: each ends with the one id whose token carries the end-of-word suffix.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self._tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(self._tokenizer.get_vocab_size(), max(vocab.values()) + 1), bool)
        self._ends[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        # Characters seen at the end of a word, and whether they end it for the tokenizer.
        self._ends_word: dict[str, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._flat, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _coded(self, strings: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array([i for own in self._coded([" ".join(words[k:k + 500]) for k in range(0, len(words), 500)]) for i in own], np.uint32)
        last = np.flatnonzero(self._ends[ids])
        if all(map(str.isalpha, words)) and len(last) == len(words) and (not len(ids) or last[-1] == len(ids) - 1):
            return ids, np.diff(last, prepend=-1)
        each = self._coded(words)
        return np.array([i for own in each for i in own], np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered words in order, and the end of each word's ids."""
        each = self._sizes[place]
        ends = np.concatenate(([0], np.cumsum(each)))
        begins = np.cumsum(self._sizes) - self._sizes
        return self._flat[np.repeat(begins[place] - ends[:-1], each) + np.arange(ends[-1])], ends

    def _remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self._place.update(zip(words, range(len(self._sizes), len(self._sizes) + len(words))))
        self._flat, self._sizes = np.concatenate((self._flat, ids)), np.concatenate((self._sizes, sizes))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words, encoding those that are not remembered."""
        coded = words.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        new = [w for w in texts if w not in self._place]
        if len(self._place) + len(new) > CACHE_WORDS:
            self._forget()
            new = texts
        for part in ([w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]):
            if part:
                self._remember(part, *self._encode_new(part))
        return np.fromiter(map(self._place.__getitem__, texts), np.int64, len(texts))[coded.indices.to_numpy()]

    def _closed(self, heads: pa.Array) -> pa.Array:
        """Whether each head ends in a letter or digit, also after the tokenizer's normalisation.

        Some letters are taken apart by it and then end in a mark, which belongs to what follows.
        """
        last = pc.utf8_slice_codeunits(heads, -1).dictionary_encode()
        ends = last.dictionary.to_pylist()
        for c in ends:
            if c not in self._ends_word:
                normal = self._tokenizer.normalizer.normalize_str(c) if self._tokenizer.normalizer else c
                self._ends_word[c] = bool(c) and all(unicodedata.category(x[-1])[0] in "LN" for x in (c, normal or " "))
        return pa.array(np.array([self._ends_word[c] for c in ends], bool)[last.indices.to_numpy()])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        if not len(coded.dictionary):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # Two parts of each word: up to its last letter or digit, and the punctuation after it.
        words = coded.dictionary
        head = pc.utf8_rtrim(words, _TAIL)
        cut = pc.or_(pc.equal(head, ""), self._closed(head))
        head = pc.if_else(cut, head, words)
        tail = _after(words, head)
        head = pc.if_else(pc.match_substring(head, "<"), head, pc.ascii_lower(head))
        place = self._places(pa.concat_arrays([head, tail]))
        pair = np.stack((place[:len(words)], place[len(words):]), axis=1)
        ids, ends = self._gather(pair[coded.indices.to_numpy()].ravel())
        return ids, np.diff(ends[2 * (bounds - bounds[0])])


def _after(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows each head in its word."""
    begins = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    sizes = np.diff(begins) - pc.binary_length(heads).to_numpy()
    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    at = np.repeat(begins[1:] - sizes - cuts[:-1], sizes) + np.arange(cuts[-1])
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(data[at])])


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def binary_pieces(tokens: int, longest: int) -> list[int]:
    """Lengths of the pieces: whole ``longest`` ones, then the set bits of the rest, falling."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Power-of-two decomposition of each document's ids (with ``end_id`` after them).

    ``longest`` must be a power of two.  Every piece is a training sequence of its own, of
    a power-of-two length: nothing is padded and no sequence crosses documents.  Pieces of
    one ``bucket`` (their length) batch together, ``longest // bucket`` to a row of
    ``longest`` tokens.  Rows: the id column, start, length, ids (binary, unsigned
    little-endian 32-bit), doc_tokens, sequence_id (unique), offset (always 0), bucket.
    Null or empty texts give the one piece ``[end_id]``; null, repeated and equal ids are
    kept row by row; other columns are ignored; an empty table gives no rows.

    A narrow pass: no shuffle, memory bounded by a slice of a batch.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, made = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in (s for b in batches for s in slices(b, "_text")):
            ids, each = coder.encode(texts_of(batch, "_text"))
            totals = each + 1
            ends = np.cumsum(totals)
            whole = np.empty(int(ends[-1]), "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(each)), each)] = ids
            whole[ends - 1] = end_id
            lengths = [binary_pieces(int(n), longest) for n in totals]
            count = np.fromiter(map(len, lengths), np.int64, len(lengths))
            length = np.fromiter((x for own in lengths for x in own), np.int64, int(count.sum()))
            begin = np.cumsum(length) - length
            row = np.repeat(np.arange(len(count)), count)
            cuts = np.append(begin, ends[-1]).astype(np.int64) * 4
            data = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([
                batch.column("_id").take(pa.array(row)), pa.array(begin - (ends - totals)[row]), pa.array(length),
                data.cast(pa.binary()), pa.array(totals[row]), pa.array(made + np.arange(len(length))),
                pa.array(np.zeros(len(length), np.int64)), pa.array(length),
            ], names=["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"])
            made += len(length)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket long"
    ).withColumnRenamed("_id", id_col)


def length_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Documents by encoded length (no special tokens): tokens, n_docs.  Null text counts 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = encoder(tokenizer), {}
        for batch in (s for b in batches for s in slices(b, "_text")):
            for n, many in zip(*np.unique(coder.encode(texts_of(batch, "_text"))[1], return_counts=True)):
                seen[int(n)] = seen.get(int(n), 0) + int(many)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["tokens", "n"])

    rows = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "tokens long, n long")
    return rows.groupBy("tokens").agg(F.sum("n").alias("n_docs"))


def length_table(counts: DataFrame, block: int = 1024) -> DataFrame:
    """Suffix and prefix sums over a length histogram, one row for each occurring length.

    docs_at_least / tokens_at_least: documents of this length or more and their tokens;
    docs_below / tokens_below: the shorter ones; truncated_tokens: what remains of the
    whole corpus if documents are cut at this length.  Between two rows every total is
    linear in the limit, so the table answers any limit exactly.  Sums run inside blocks
    of ``block`` lengths, and only block totals meet in one window, so no task holds the
    whole histogram.  An empty histogram gives no rows.
    """
    own = counts.withColumn("_block", F.floor(F.col("tokens") / block)).withColumn("_t", F.col("tokens") * F.col("n_docs"))
    blocks = own.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("_bd", "_bt")),
        F.sum("_bd").over(every).alias("total_docs"), F.sum("_bt").over(every).alias("total_tokens"),
    )
    here = Window.partitionBy("_block").orderBy(F.col("tokens").desc())
    return own.join(blocks, "_block").select(
        "tokens", "n_docs",
        (F.sum("n_docs").over(here) + F.col("_bd_after")).alias("docs_at_least"),
        (F.sum("_t").over(here) + F.col("_bt_after")).alias("tokens_at_least"),
        "total_docs", "total_tokens",
    ).select(
        "tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("total_tokens") - F.col("tokens_at_least")).alias("tokens_below"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        "total_docs", "total_tokens",
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens kept and documents cut for each context limit: limit, kept_tokens, cut_docs."""
    asked = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("limit")
    fits = F.col("tokens") <= F.col("limit")
    kept = F.least("tokens", "limit") * F.col("n_docs")
    return table.select(asked, "tokens", "n_docs").groupBy("limit").agg(
        F.sum(kept).alias("kept_tokens"), F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("cut_docs"))


def length_quantile(share: float) -> Column:
    """Smallest length that at least ``share`` of the documents do not exceed, as an aggregate of the table."""
    return F.min(F.when(F.col("docs_below") + F.col("n_docs") >= F.ceil(F.lit(share) * F.col("total_docs")), F.col("tokens")))
