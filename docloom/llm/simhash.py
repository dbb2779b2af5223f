"""SimHash near-duplicates by meet-in-the-middle ball hashing of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.common import slices, texts_of, wrapped
from docloom.llm.components import components

SEED = 42
# Blocks that are blanked in turn to see which fingerprints may have a neighbour at all.
BLANKS = 4


def fingerprint(text: str, words: int = 3) -> int:
    """Majority of the bits of the XXH64 hashes of the text's word shingles, as unsigned 64 bits."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    if len(own) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip((np.concatenate(([0], ends[:-words] + 1))).tolist(), ends[words - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a signed long) of every row.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  Texts of fewer
    words are one shingle, a null text or one without words has fingerprint 0.
    """
    schema = StructType([*(docs.schema[c] for c in keep), StructField("fp", LongType())])
    text = text_col if text_col in keep else "_text"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, text)):
            own = [fingerprint(t, words) for t in texts_of(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(own, np.uint64).view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("_text")])).mapInArrow(run, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(masks: Iterable[int]) -> Column:
    return F.array(*(F.lit(_signed(m)).cast("long") for m in masks))


def crowded(fps: DataFrame) -> DataFrame:
    """The fingerprints that may have another within three bits, and surely all that do.

    A block of 16 bits is blanked in turn.  Of three differing bits one lies in some block;
    with that block blanked two are left, and the balls of radius one around both meet.
    A bucket holds distinct fingerprints that differ in the blank and two bits at most.
    """
    width = 64 // BLANKS
    low = (1 << width) - 1
    parts, back = [], F.lit(None).cast("long")
    for block in range(BLANKS):
        rest = ~(low << block * width) & (1 << 64) - 1
        own = _flips([0, *(1 << b for b in range(64) if rest >> b & 1)])
        # The key's blank holds the block's number; what leaves the fingerprint out of the key
        # (the blanked bits and the flip's place) fits an int, which keeps the shuffle narrow.
        mark = F.lit(_signed((block + 1) << block * width)).cast("long")
        base = F.col("fp").bitwiseAND(F.lit(_signed(rest)).cast("long")).bitwiseOR(mark)
        blanked = F.shiftrightunsigned("fp", block * width).bitwiseAND(F.lit(low).cast("long")).cast("int")
        parts.append(fps.select(base.alias("base"), blanked.alias("blanked"), F.posexplode(own).alias("place", "flip")).select(
            F.col("base").bitwiseXOR(F.col("flip")).alias("key"),
            F.col("blanked").bitwiseOR(F.shiftleft("place", width)).bitwiseOR(F.lit(block << width + 6)).alias("left_out")))
        key = F.col("key").bitwiseAND(F.lit(_signed(rest)).cast("long"))
        flip = F.element_at(own, F.shiftright("left_out", width).bitwiseAND(F.lit(63)) + 1)
        bits = F.shiftleft(F.col("left_out").bitwiseAND(F.lit(low)).cast("long"), block * width)
        back = F.when(F.shiftright("left_out", width + 6) == block, key.bitwiseXOR(flip).bitwiseOR(bits)).otherwise(back)
    variants = parts[0]
    for more in parts[1:]:
        variants = variants.union(more)
    bucket = Window.partitionBy("key").orderBy("left_out")
    near = variants.withColumn("_before", F.lag("left_out").over(bucket)).withColumn("_after", F.lead("left_out").over(bucket))
    return near.where(F.col("_before").isNotNull() | F.col("_after").isNotNull()).select(back.alias("fp")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """Links a < b between distinct fingerprints that connect all pairs within three bits.

    Meet in the middle: every fingerprint emits all variants within one bit.  Two within two
    bits share a variant.  Two at three bits differ in parity, and two of the three bits lie
    in one half; so the odd one emits also the variants of two bits in one half, and meets
    the even one at that one's variant of the third bit.  On each variant the members within
    one bit all link to the smallest of them, and so do the members at two bits, which are
    within three of it.  Fingerprints being distinct, a variant has 65 of the first kind and
    992 of the second at most, however large a group of near copies is.
    """
    ones = [0, *(1 << b for b in range(64))]
    twos = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i)
            if j >= half]
    odd = F.bit_count("fp") % 2 == 1
    near = fps.select("fp", F.explode(_flips(ones)).alias("flip"), F.lit(1).cast("byte").alias("far"))
    far = fps.where(odd).select("fp", F.explode(_flips(twos)).alias("flip"), F.lit(2).cast("byte").alias("far"))
    met = near.union(far).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp", "far")
    on = Window.partitionBy("variant").orderBy("far", "fp")
    return (
        met.withColumn("a", F.first("fp").over(on)).withColumn("lead_far", F.first("far").over(on))
        .where((F.col("lead_far") == 1) & (F.col("a") != F.col("fp")))
        .select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    )


def groups(marked: DataFrame, id_col: str) -> DataFrame:
    """Of every fingerprint of ``marked``: its group's root fingerprint and smallest id (component_id)."""
    own = marked.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = components(links(crowded(own.select("fp"))))
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select(own["fp"], "_least", F.coalesce("root", own["fp"]).alias("root"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, fp, fingerprint (16 lowercase hex digits) and component_id of every row.

    Documents link when their fingerprints differ in three bits or fewer; component_id is the
    smallest id reachable.  Only distinct fingerprints are hashed, linked and contracted, so
    groups of copies cost one row; they meet the documents again by fingerprint.  Rows with
    a null id take part in linking and get the component's smallest non-null id, or null if
    there is none; repeated rows are kept.  An empty table gives no rows.
    """
    marked = fingerprints(docs, words, text_col, (id_col,))
    return marked.join(groups(marked, id_col), "fp").select(
        id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id, with all columns of ``docs``.

    Of rows with that same id one stays; a group of null ids keeps one of them.  Null texts
    are one group with the other texts without words.
    """
    plain = groups(fingerprints(docs, words, text_col, (id_col,)), id_col)
    marked = fingerprints(wrapped(docs, text_col), words, "text", ("row",))
    heads = marked.join(plain, "fp").where(F.col(f"row.{id_col}").eqNullSafe(F.col("component_id")))
    return heads.dropDuplicates(["root"]).select("row.*")
