"""Quality: a byte-level convolutional network in numpy over overlapping chunks of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docloom.llm.common import slices, texts_of

# Bytes a filter sees (even), filter positions of a chunk, filters, byte embedding size.
WIDTH, CHUNK, FILTERS, DIMS = 6, 256, 12, 8
# Chunks that one convolution step holds.
STEP = 512


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all chunks (each overlaps the next by WIDTH - 1), valid positions, first chunk of each text.

    Positions 0 .. n-1 of a text of n bytes are all covered; bytes past its end are zero.
    An empty text has one chunk with one position.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    many = np.maximum(1, -(-sizes // CHUNK))
    firsts = np.cumsum(many) - many
    flat = np.zeros(int(many.sum()) * CHUNK + WIDTH, np.uint8)
    starts = np.cumsum(sizes) - sizes
    flat[np.arange(int(sizes.sum())) + np.repeat(firsts * CHUNK - starts, sizes)] = np.frombuffer(b"".join(parts), np.uint8)
    whole = np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH - 1)[::CHUNK][:int(many.sum())].copy()
    left = np.repeat(sizes, many) - (np.arange(int(many.sum())) - np.repeat(firsts, many)) * CHUNK
    valid = np.clip(left, 1, CHUNK)
    # A last chunk ends with its text: the next text's bytes are not its own.
    whole[np.arange(CHUNK + WIDTH - 1) >= np.maximum(left, 0)[:, None]] = 0
    return whole, valid, firsts


@dataclass
class QualityModel:
    """Byte embeddings, filters and the output layer; the size is fixed."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float

    def pairs(self) -> list[np.ndarray]:
        """Response of every filter to every pair of neighbouring bytes, for each pair in the width."""
        one = np.einsum("bd,kdf->kbf", self.embed, self.filters)
        return [np.ascontiguousarray((one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1), np.float32) for k in range(0, WIDTH, 2)]

    def responses(self, chunks: np.ndarray, valid: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk and where it is."""
        best, where = [], []
        for k in range(0, len(chunks), STEP):
            own = chunks[k:k + STEP].astype(np.int32)
            pair = own[:, :-1] << 8 | own[:, 1:]
            found = tables[0][pair[:, :CHUNK]]
            for j in range(1, len(tables)):
                found += tables[j][pair[:, 2 * j:2 * j + CHUNK]]
            found[np.arange(CHUNK) >= valid[k:k + STEP, None]] = -np.inf
            at = found.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(found, at[:, None, :], axis=1)[:, 0, :])
        return np.concatenate(best), np.concatenate(where)

    def features(self, best: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Of each text: largest and mean chunk maximum of every filter, squashed."""
        active = np.tanh(best + self.bias)
        many = np.diff(np.append(firsts, len(best)))
        return np.hstack((np.maximum.reduceat(active, firsts), np.add.reduceat(active, firsts) / many[:, None]))

    def score(self, texts: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        chunks, valid, firsts = chunked(texts)
        best, _ = self.responses(chunks, valid, tables)
        return 1 / (1 + np.exp(-(self.features(best, firsts) @ self.out + self.base)))


def fit(rows: list[tuple[str, int]], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> QualityModel:
    """Train all layers by Adam on whole (text, 0/1) texts; the rows are bounded by the caller.

    Without rows, or with one label only, the output layer is zero and every score is the
    smoothed base rate.
    """
    rng = np.random.default_rng(seed)
    labels = np.array([r[1] for r in rows], np.float64)
    base = (labels.sum() + 0.5) / (len(labels) + 1)
    model = QualityModel(rng.normal(0, 0.3, (256, DIMS)), rng.normal(0, 0.3, (WIDTH, DIMS, FILTERS)), np.zeros(FILTERS),
                         np.zeros(2 * FILTERS), float(np.log(base / (1 - base))))
    if not 0 < labels.sum() < len(labels):
        return model
    chunks, valid, firsts = chunked(pa.array([r[0] for r in rows], pa.string()))
    ends = np.append(firsts[1:], len(chunks))
    model.out = rng.normal(0, 0.1, 2 * FILTERS)
    params = [model.embed, model.filters, model.bias, model.out, np.array([model.base])]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            own = order[start:start + batch]
            many = ends[own] - firsts[own]
            heads = np.cumsum(many) - many
            pick = np.arange(int(many.sum())) + np.repeat(firsts[own] - heads, many)
            best, where = model.responses(chunks[pick], valid[pick], model.pairs())
            active = np.tanh(best + model.bias)
            top = np.maximum.reduceat(active, heads)
            feats = np.hstack((top, np.add.reduceat(active, heads) / many[:, None]))
            error = (1 / (1 + np.exp(-(feats @ model.out + params[4][0]))) - labels[own]) / len(own)
            down = error[:, None] * model.out
            pull = np.repeat(down[:, FILTERS:] / many[:, None], many, axis=0)
            pull += (active == np.repeat(top, many, axis=0)) * np.repeat(down[:, :FILTERS], many, axis=0)
            pull *= 1 - active * active
            seen = chunks[pick][np.arange(len(pick))[:, None, None], where[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
            to_filter, to_embed = np.zeros_like(model.filters), np.zeros_like(model.embed)
            for k in range(WIDTH):
                for f in range(FILTERS):
                    by_byte = np.bincount(seen[:, f, k], pull[:, f], 256)
                    to_filter[k, :, f] = by_byte @ model.embed
                    to_embed += by_byte[:, None] * model.filters[k, :, f]
            grads = [to_embed, to_filter, pull.sum(axis=0), feats.T @ error + 1e-4 * model.out, np.array([error.sum()])]
            step += 1
            for value, grad, (m, v) in zip(params, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.base = float(params[4][0])
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the probability ``score`` of label 1 for every whole text.

    A narrow pass with the fixed-size model broadcast; memory is that of one slice of texts.
    A null or empty text is one chunk of padding and scores like it.  Repeats, ties and nulls
    in other columns pass through row by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.pairs()
        for batch in (s for b in batches for s in slices(b, "_text", 4 << 20)):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(texts_of(batch, "_text"), tables))], names=[*keep, "score"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
