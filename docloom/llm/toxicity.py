"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docloom.llm.common import code_points, pieces, slices, texts_of
from docloom.llm.langid import letters

ORDERS = (3, 4, 5)
BITS = 17
# Neutral words that every bag also holds, so that a few words do not make a verdict.
NEUTRAL = 5


@dataclass
class Words:
    """Subwords of all words of some texts: buckets, the start of each word's, and each text's words."""

    buckets: np.ndarray
    word_starts: np.ndarray
    text_words: np.ndarray


def subwords(texts: pa.Array) -> Words:
    """Hashed n-grams of every word, its borders included, so that spellings share most of them.

    A word is a run of letters and digits (and of the signs that stand in for letters);
    a word too short for any n-gram is one bucket of its own.
    """
    codes, starts = code_points(texts, 1)
    inside = letters()[codes] | ((codes >= 48) & (codes <= 57)) | (codes == 64)
    codes = np.where(inside, codes, 32).astype(np.uint32)
    bordered = np.concatenate(([np.uint32(32)], codes))  # every word stands between two spaces
    inside = np.concatenate(([False], inside))
    first = np.flatnonzero(inside & ~np.roll(inside, 1))
    last = np.flatnonzero(inside & ~np.roll(inside, -1))
    sizes = last - first + 3  # with both borders
    begin = first - 1
    longest = max(ORDERS)
    each = sum(np.maximum(sizes - n + 1, 0) for n in ORDERS) + 1  # n-grams and the whole word
    word_starts = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.int32)
    filled = word_starts.copy()
    mixed = np.zeros(len(bordered), np.uint32)
    for n in range(1, longest + 1):
        ahead = np.full(len(bordered), 32, np.uint32)
        ahead[:max(0, len(bordered) - n + 1)] = bordered[n - 1:]
        mixed = mixed * np.uint32(0x01000193) + ahead + np.uint32(n)
        if n in ORDERS:
            count = np.maximum(sizes - n + 1, 0)
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            hashed = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            out[np.repeat(filled, count) + within] = hashed[np.repeat(begin, count) + within]
            filled += count
    whole = mixed[begin] * np.uint32(0x85EBCA6B) + mixed[np.maximum(last - longest + 2, 0)] + sizes.astype(np.uint32)
    out[filled] = (whole * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    edges = np.searchsorted(first, np.append(starts + 1, len(bordered)))
    return Words(out, word_starts, edges)


@dataclass
class ToxicityModel:
    """Logit of every subword bucket (embedding times output weights) and the bias; fixed size."""

    logits: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        total, many = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, part in pieces(texts):
            words = subwords(part)
            sizes = np.diff(np.append(words.word_starts, len(words.buckets)))
            own = np.zeros(0) if not len(sizes) else np.add.reduceat(self.logits[words.buckets], words.word_starts, dtype=np.float64) / sizes
            ends = np.concatenate(([0.0], np.cumsum(own)))
            np.add.at(total, owner, np.diff(ends[words.text_words]))
            np.add.at(many, owner, np.diff(words.text_words))
        bag = total / (many + NEUTRAL)
        return 1 / (1 + np.exp(-np.clip(bag + self.bias, -60, 60)))


def _shares(texts: list[str], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and percent of the text's bag for every subword of some texts."""
    words = subwords(pa.array(texts, pa.string()))
    sizes = np.diff(np.append(words.word_starts, len(words.buckets)))
    count = np.diff(words.text_words)
    text = np.repeat(np.repeat(np.arange(len(texts)), count), sizes)
    share = np.repeat(100 / (np.repeat(count + NEUTRAL, count) * sizes), sizes)
    cell, place = np.unique(text << BITS | words.buckets, return_inverse=True)
    return (cell >> BITS).astype(np.int32) + np.int32(first), (cell & (1 << BITS) - 1).astype(np.int32), np.bincount(place, share, len(cell)).astype(np.float32)


def fit(rows: list[tuple[str, int]], dims: int = 16, epochs: int = 120, rate: float = 0.4, decay: float = 1e-4,
        least: int = 10, seed: int = 7) -> ToxicityModel:
    """Train embeddings and output weights jointly by Adam on (text, 0/1) rows.

    A text's vector is the mean over its words of the mean over their subwords' embeddings;
    a linear softmax of two classes reads it.  Subwords of fewer than ``least`` texts keep no
    weight, so rare words are read through the n-grams they share with others.  The rows are
    bounded by the caller.  Without rows, or with one label only, the model answers with the
    smoothed base rate.
    """
    labels = np.array([r[1] for r in rows], np.float64)
    base = (labels.sum() + 0.5) / (len(labels) + 1)
    logits = np.zeros(1 << BITS, np.float32)
    if not 0 < labels.sum() < len(labels):
        return ToxicityModel(logits, float(np.log(base / (1 - base))))
    parts = [_shares([r[0] for r in rows[k:k + 64]], k) for k in range(0, len(rows), 64)]
    seen = sum(np.bincount(p[1], minlength=1 << BITS) for p in parts)
    used = np.flatnonzero(seen >= least)
    at = np.full(1 << BITS, -1, np.int32)
    at[used] = np.arange(len(used))
    for k, (doc, bucket, part) in enumerate(parts):
        kept = at[bucket] >= 0
        parts[k] = doc[kept], at[bucket[kept]], part[kept]
    doc, bucket, part = map(np.concatenate, zip(*parts))
    del parts
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (len(used), dims))
    out = rng.normal(0, 0.3, (dims, 2))
    bias = np.array([0.0, np.log(base / (1 - base))])
    params = [table, out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, epochs + 1):
        toxic = out[:, 1] - out[:, 0]
        logit = np.bincount(doc, (table @ toxic).astype(np.float32)[bucket] * part, len(rows)) + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels) / len(labels)
        pull = np.bincount(bucket, error.astype(np.float32)[doc] * part, len(used))
        toward = table.T @ pull
        grads = [np.outer(pull, toxic) + decay * table / len(labels) ** 0.5, np.stack((-toward, toward), axis=1), np.array([-error.sum(), error.sum()])]
        for value, grad, (m, v) in zip(params, grads, moments):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.999 ** epoch)) + 1e-6)
    logits[used] = 100 * (table @ (out[:, 1] - out[:, 0]))
    return ToxicityModel(logits, float(bias[1] - bias[0]))


def fit_in_task(rows: DataFrame) -> ToxicityModel:
    """``fit`` on a bounded table (text, label), in one task, so that the driver only gets the model."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [x for b in batches for x in zip(b.column("text").to_pylist(), b.column("label").to_pylist())]
        model = fit(own)
        yield pa.RecordBatch.from_arrays([pa.array([model.logits.tobytes()]), pa.array([model.bias])], names=["logits", "bias"])

    got = rows.repartition(1).mapInArrow(run, "logits binary, bias double").first()
    if got is None:  # no row, no task
        return fit([])
    return ToxicityModel(np.frombuffer(got["logits"], np.float32), got["bias"])


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every whole text.

    A narrow pass with the fixed-size model broadcast.  A null or empty text, or one without
    letters and digits, scores as an empty bag: the model's bias.  Repeats, ties and nulls
    in other columns pass through row by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType())])
    text = text_col if text_col in keep else "_text"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, text, 2 << 20)):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(texts_of(batch, text)))], names=[*keep, "score"])

    return docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("_text")])).mapInArrow(run, schema)
