"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docloom.llm.common import code_points, pieces, slices, texts_of

ORDERS = (1, 2, 3)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-grams at every position (orders x positions), text starts, has-a-letter.

    Texts are lower-cased and whatever is no letter counts as a space; the spaces after
    each text keep n-grams inside it.
    """
    codes, starts = code_points(texts, max(ORDERS))
    letter = letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    mixed, out = np.zeros(len(codes), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        ahead = np.full(len(codes), 32, np.uint32)
        ahead[:max(0, len(codes) - n + 1)] = codes[n - 1:]
        mixed = mixed * np.uint32(0x01000193) + ahead + np.uint32(n)
        if n in ORDERS:
            out.append(((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32))
    return np.stack(out), starts, np.add.reduceat(letter.astype(np.int64), starts) > 0


@dataclass
class LanguageModel:
    """Log probabilities (buckets x languages) and log priors; size is languages x 2**bits floats."""

    names: list[str]
    priors: np.ndarray
    weights: np.ndarray
    bits: int


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", bits: int = 16,
          smoothing: float = 0.1, max_languages: int = 400) -> LanguageModel:
    """Count the n-grams of every usable text of non-null language.

    Counting is distributed over all rows: each task sums its own texts, the sums meet by
    (language, bucket), and at most ``max_languages`` x 2**bits of them reach the driver;
    more languages raise ValueError.  Null texts count as empty; no usable row gives a model
    without languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & usable).select(
        F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (s for b in batches for s in slices(b, "_text")):
            names = batch.column("_lang").to_pylist()
            known = {name: k for k, name in enumerate(dict.fromkeys(names))}
            lang = np.array([known[x] for x in names])
            for owner, part in pieces(texts_of(batch, "_text")):
                found, starts, _ = grams(part, bits)
                at = np.repeat(lang[owner], np.diff(np.append(starts, found.shape[1]))) << bits
                counts = sum(np.bincount(at + row, minlength=len(known) << bits) for row in found).reshape(len(known), -1)
                for name, k in known.items():
                    sums.setdefault(name, np.zeros((1 << bits) + 1, np.int64))[:-1] += counts[k]
            for name in known:
                sums[name][-1] += names.count(name)  # the last cell counts documents
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "bucket", "n"])

    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.limit(max_languages * ((1 << bits) + 1) + 1).toPandas()
    names = sorted(got["lang"].unique())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((len(names), (1 << bits) + 1))
    counts[pd.Categorical(got["lang"], categories=names).codes, got["bucket"]] = got["n"]
    grams_seen = counts[:, :-1] + smoothing
    weights = np.log(grams_seen / grams_seen.sum(axis=1, keepdims=True)) if names else grams_seen
    priors = np.log(counts[:, -1] / counts[:, -1].sum()) if names else np.zeros(0)
    return LanguageModel(names, priors, np.ascontiguousarray(weights.T, np.float32), bits)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and its posterior ``score`` for every row.

    The score matrix is broadcast (bounded by the model's size).  A text that is null or has
    no letter is ``und`` with score 0; a model without languages says so for every text.
    Ties take the first language in order.  Nulls and repeats in other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (s for b in batches for s in slices(b, "_text", 4 << 20)):
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model.names:
                total, lettered = np.tile(model.priors, (batch.num_rows, 1)), np.zeros(batch.num_rows, bool)
                for owner, part in pieces(texts_of(batch, "_text")):
                    found, starts, any_letter = grams(part, model.bits)
                    np.logical_or.at(lettered, owner, any_letter)
                    for k in range(len(model.names)):
                        own = np.ascontiguousarray(model.weights[:, k])
                        np.add.at(total[:, k], owner, np.add.reduceat(sum(own[row] for row in found).astype(np.float64), starts))
                total -= total.max(axis=1, keepdims=True)
                share = np.exp(total)
                best = total.argmax(axis=1)
                names = np.where(lettered, np.array(model.names, object)[best], "und")
                score = np.where(lettered, 1 / share.sum(axis=1), 0.0)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
