"""Exact removal of long repeated byte strings, by hash-compared suffix sort of candidate places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bytes_hash import PrefixHash, mixed
from docloom.llm.common import ensure_checkpoint_dir, slices, texts_of
from docloom.llm.suffix_sort import repeated

# Bytes of an anchor, text bytes of one vectorised step, contexts that one group sorts.
ANCHOR, STEP_BYTES, GROUP = 72, 3 << 20, 4096
_LOW = np.uint64(0xFFFFFF)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def _runs(hashes: PrefixHash, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of places whose ``length``-byte strings have the same anchor: text, first, last, anchor.

    The anchor of a string is the leftmost of its ANCHOR-byte parts with the smallest hash,
    so equal strings have it at the same distance wherever they stand.
    """
    width = length - ANCHOR + 1
    keys = mixed(hashes.every(ANCHOR))
    keys &= ~_LOW
    keys |= np.arange(len(keys), dtype=np.uint64)
    tail = -len(keys) % width
    blocks = np.append(keys, np.full(tail, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    many = len(keys) - width + 1
    least = np.minimum(behind[:many], ahead[width - 1:width - 1 + many])
    text = np.flatnonzero(ends - starts >= length)
    change = np.unique(np.concatenate((np.flatnonzero(least[1:] != least[:-1]) + 1, starts[text], ends[text] - length + 1)))
    change = change[change <= many]
    first, last = change[:-1], change[1:] - 1
    first, last = np.append(first, change[-1:]), np.append(last, many - 1)
    owner = np.searchsorted(starts, first, side="right") - 1
    fits = (first <= last) & (first + length <= ends[owner])
    first, last, owner = first[fits], last[fits], owner[fits]
    return owner, first, last, (least[first] & _LOW).astype(np.int64)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """Very long texts in parts that together hold every place once: text, offset, part."""
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), STEP_BYTES):
            yield k, at, t[at:at + STEP_BYTES + length - 1]


def _grouped(items: Iterable, size) -> Iterator[list]:
    held, total = [], 0
    for x in items:
        if held and total + size(x) > 2 * STEP_BYTES:
            yield held
            held, total = [], 0
        held.append(x)
        total += size(x)
    if held:
        yield held


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """Anchored runs of every distinct text of a task: h1, h2, k1, pack, many, extra.

    h1 and h2 hash the anchor and the whole run's bytes; pack holds the text key's other part
    and the run (first place, its number of places, the anchor's distance).  Runs of equal
    bytes within a step meet there: one stands for all (``many``), the others are known to
    repeat (``extra``), so a passage that every text has leaves few rows a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in (s for b in batches for s in slices(b, "text", STEP_BYTES)):
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            raw = texts_of(batch, "text").cast(pa.binary()).to_pylist()
            new = [k for k in range(len(keys)) if len(raw[k]) >= length and keys[k] not in seen and not seen.add(keys[k])]
            for own in _grouped(_pieces([raw[k] for k in new], length), lambda p: len(p[2])):
                data, starts, ends = _flat([p[2] for p in own])
                hashes = PrefixHash(data)
                text, first, last, anchor = _runs(hashes, starts, ends, length)
                if not len(text):
                    continue
                h1 = mixed(hashes.of(anchor, ANCHOR))
                h2 = mixed(hashes.of(first, last - first + length) + (anchor - first).astype(np.uint64))
                offset = np.array([p[1] for p in own])[text] + first - starts[text]
                who = np.array([new[p[0]] for p in own])[text]
                k1 = np.array([k[0] for k in keys], np.int64)[who]
                k2 = np.array([k[1] for k in keys], np.int64)[who]
                pack = k2 << 48 | (last - first) << 40 | (anchor - first) << 32 | offset
                _, head, place, count = np.unique(h2 ^ mixed(h1), return_index=True, return_inverse=True, return_counts=True)
                extra = head[place] != np.arange(len(place))
                h1[extra] = mixed(k1[extra].view(np.uint64) ^ pack[extra].view(np.uint64))  # they meet no group
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(k1), pa.array(pack),
                                                  pa.array(count[place] > 1), pa.array(extra)], names=["h1", "h2", "k1", "pack", "many", "extra"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "h1 long, h2 long, k1 long, pack long, many boolean, extra boolean")


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of the listed runs: key, ctx, anchor, k1, k2, at, sure.

    A run of a group of more than GROUP is cut into its single strings, each keyed by its own
    hash, so that no group grows with the corpus; equal strings of a step again leave one
    row that stands for all, and the others as results (no ctx).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names = ["key", "ctx", "anchor", "k1", "k2", "at", "sure"]
        for batch in (s for b in batches for s in slices(b, "text", STEP_BYTES)):
            rows, whole = [], []
            for k1, k2, text, listed in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "runs"))):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                raw = text.encode("utf-8", "surrogatepass")
                for r in listed:
                    at, places, anchor = r["pack"] & 0xFFFFFFFF, (r["pack"] >> 40 & 0xFF) + 1, r["pack"] >> 32 & 0xFF
                    if r["hot"]:
                        whole.extend((raw[p:p + length], k1, k2, p) for p in range(at, at + places))
                    else:
                        rows.append((r["h1"], raw[at:at + places + length - 1], anchor, k1, k2, at, False))
            if whole:
                data, starts, _ = _flat([w[0] for w in whole])
                hashes = PrefixHash(data)
                key = mixed(hashes.of(starts, length)).view(np.int64)
                groups = np.argsort(key, kind="stable")
                number = np.cumsum(np.append(0, key[groups][1:] != key[groups][:-1]))
                twice = np.zeros(len(whole), bool)
                twice[groups] = repeated(hashes, starts[groups], number, length)
                stands: set[int] = set()
                for j, (ctx, k1, k2, p) in enumerate(whole):
                    again = bool(twice[j]) and int(key[j]) in stands
                    stands.add(int(key[j]))
                    rows.append((int(key[j]) if not again else k1, None if again else ctx, 0, k1, k2, p, bool(twice[j])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=names)

    return joined.mapInArrow(run, "key long, ctx binary, anchor int, k1 long, k2 long, at long, sure boolean")


def _sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated places of the contexts: k1, k2, first, last.  Each key's contexts are sorted as suffixes."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ctx = table.column("ctx").to_pylist()
        keys = table.column("key").to_numpy()
        anchor, at = table.column("anchor").to_numpy().astype(np.int64), table.column("at").to_numpy()
        data, starts, ends = _flat(ctx)
        places = ends - starts - length + 1
        who = np.repeat(np.arange(len(ctx)), places)
        step = np.arange(len(who)) - np.repeat(np.cumsum(places) - places, places)
        number = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
        # Only strings with the anchor at the same distance can be equal.
        group = number[who] * 512 + (anchor[who] - step + 256)
        by = np.argsort(group, kind="stable")
        found = np.zeros(len(who), bool)
        found[by] = repeated(PrefixHash(data), (starts[who] + step)[by], group[by], length)
        found |= table.column("sure").to_numpy(zero_copy_only=False)[who]
        hit = np.flatnonzero(found)
        if len(hit):
            head = np.append(True, (np.diff(hit) != 1) | (np.diff(who[hit]) != 0))
            first = hit[head]
            last = np.append(hit[np.flatnonzero(head)[1:] - 1], hit[-1])
            own = pa.array(who[first])
            yield pa.RecordBatch.from_arrays([table.column("k1").take(own).combine_chunks(), table.column("k2").take(own).combine_chunks(),
                                              pa.array(at[who[first]] + step[first]), pa.array(at[who[last]] + step[last])], names=["k1", "k2", "first", "last"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("ctx")))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(c) for c in ("k1", "k2", "at", "at")], names=["k1", "k2", "first", "last"])
            batch = batch.filter(pc.is_valid(batch.column("ctx")))
            for start in range(0, batch.num_rows, 2048):
                held.append(batch.slice(start, 2048))
                if sum(b.num_rows for b in held) < GROUP:
                    continue
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield from settle(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    spread = contexts.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "k1 long, k2 long, first long, last long")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    Rows: id column, kept (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed
    runs), for every document row.  Texts are UTF-8 bytes, null is empty; matches never cross
    documents; strings are judged on the input.  Repeated rows, equal ids and null ids are
    documents of their own: a text that occurs twice is a copy and goes as a whole.  An empty
    table gives no rows.

    1. Every string has an anchor that depends on its bytes alone; runs of places with one
       anchor are found in a narrow pass, and only runs whose anchor occurs elsewhere go on.
    2. Runs that are equal as a whole repeat at every place.  The others, with one run of each
       equal class beside them, send their bytes to their anchor's group.
    3. A group's suffixes are sorted by hash-compared mergesort; neighbours that share
       ``length`` bytes, verified byte by byte, repeat.
    Groups of more than GROUP runs are split by the hash of the string itself.
    """
    if not ANCHOR <= length <= ANCHOR + 255:
        raise ValueError("length must lie between the anchor's size and 255 more")
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", "text", F.xxhash64("text").alias("k1"), F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(0x7FFF)).alias("k2"))
    runs = anchors(texts, length)
    shared = runs.where(~F.col("extra")).groupBy("h1").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1").select("h1")
    near = runs.join(shared.withColumn("met", F.lit(True)), "h1", "left").where(F.col("extra") | F.col("met")).drop("met").checkpoint()
    classes = near.where(~F.col("extra")).groupBy("h1", "h2").agg(
        F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), F.min(F.struct("k1", "pack")).alias("stands"))
    sizes = classes.groupBy("h1").agg(F.count("*").alias("classes"))
    k2 = F.shiftrightunsigned("pack", 48)
    at = F.col("pack").bitwiseAND(F.lit(0xFFFFFFFF))
    last = at + F.shiftrightunsigned("pack", 40).bitwiseAND(F.lit(0xFF).cast("long"))
    judged = near.where(~F.col("extra")).join(classes.where("n > 1").select("h1", "h2"), ["h1", "h2"], "left_semi")
    equal = judged.union(near.where("extra")).select("k1", k2.alias("k2"), at.alias("first"), last.alias("last"))
    listed = classes.join(sizes.where("classes > 1"), "h1").select(
        "stands.k1", F.shiftrightunsigned("stands.pack", 48).alias("k2"),
        F.struct("h1", "stands.pack", (F.col("classes") > GROUP).alias("hot")).alias("run"),
    ).groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))
    sorted_ = _sorted_repeats(_contexts(texts.join(listed, ["k1", "k2"]), length), length)
    spans = equal.union(sorted_).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    copies = texts.select("k1", "k2").groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    known = copies.join(spans, ["k1", "k2"], "full_outer")
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text", STEP_BYTES)):
            rows = []
            for raw, copied, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("copies").to_pylist(), batch.column("spans").to_pylist()):
                if copied and len(raw) >= length:
                    rows.append((b"", len(raw), len(raw), 1))
                    continue
                kept, done, spans = [], 0, 0
                for a, b in sorted((x["first"], x["last"] + length) for x in found or ()):
                    if a > done or not spans:
                        kept.append(raw[done:a])
                        spans += 1
                    done = max(done, b)
                rest = b"".join([*kept, raw[done:]])
                rows.append((rest, len(raw), len(raw) - len(rest), spans))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.binary(), pa.int64(), pa.int64(), pa.int64())))], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    return texts.join(known, ["k1", "k2"], "left").mapInArrow(
        cut, f"id {id_type}, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("id", id_col)
