"""Best rows by summed term weights for many questions: cells of rows and questions, scored inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

# Rows and questions of a cell, and the terms of its rows that are read at a time.
CELL_ROWS, CELL_QUESTIONS = 250_000, 200_000
FIRST_TERMS, SCORED_TERMS = 500_000, 4_000_000
# Postings that are scored at a time; the first few set the questions' thresholds, and each time there may be GROWTH times as many.
FIRST_POSTINGS, SCORED_POSTINGS, GROWTH = 250_000, 6_000_000, 5
# A term that this share of a block's rows has is a whole line of numbers, not a list.
DENSE = 1 / 16
# Questions whose bounds are computed at a time.
BOUND_QUESTIONS = 5_000
# Bounds are whole numbers of two bytes: the greatest sum that most questions may have, and that share of them.
FULL, MOST_QUESTIONS = 60_000, 0.9
# So many rows are scored at once without a closer look.
FEW_ROWS = 20
# Scores are rounded to nine digits; bounds leave room for that and for the order of sums.
SLACK = 1e-8

# Between the terms of a row while it is shuffled; no term has it.
BREAK = "\0"

Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All entries of a list column in order, and how many each row has."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _split(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its joined terms as lists again; null for none."""
    at = batch.schema.get_field_index("terms")
    return batch.set_column(at, "terms", pc.split_pattern(batch.column(at), BREAK))


class _Asked:
    """A cell's questions: numbered terms with shares, the best rows so far and the score to pass."""

    def __init__(self, rows: pa.Table, k: int, floor: float):
        self.rep = rows.column("rep").to_numpy()
        terms, self.sizes = _lists(rows.column("terms").combine_chunks())
        self.shares = _lists(rows.column("numbers").combine_chunks())[0].to_numpy(zero_copy_only=False)
        scopes = rows.column("scope").combine_chunks()
        self.terms, self.scopes = pc.unique(terms), pc.unique(scopes)
        own = pc.index_in(scopes, value_set=self.scopes).to_numpy()
        self.average = np.ones(len(self.scopes))
        self.average[own] = rows.column("average").to_numpy()
        # A term counts within its scope: the pair has one number.
        pairs = np.repeat(own.astype(np.int64), self.sizes) * len(self.terms) + pc.index_in(terms, value_set=self.terms).to_numpy()
        self.pairs, self.numbers = np.unique(pairs, return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.score, self.row = np.full((len(self.rep), k), -1.0), np.full((len(self.rep), k), -1, np.int64)
        self.k, self.floor, self.least, self.full = k, floor, np.full(len(self.rep), floor), np.zeros(len(self.rep), bool)
        self.query = np.zeros(len(self.pairs))
        # A plan, if there is one: the least weight a term's rows enter with, what the others can add, and a threshold.
        self.unread, late = None, np.zeros(len(self.shares), bool)
        if rows.column("cuts").null_count < len(self.rep):
            late = np.isinf(_lists(rows.column("cuts").combine_chunks())[0].to_numpy(zero_copy_only=False))
            self.unread, self.least = rows.column("unread").to_numpy(), np.maximum(floor, rows.column("least").to_numpy())
        self.planned = np.add.reduceat((~late).astype(np.int64), self.ends - self.sizes)
        # A question's terms by falling share, so that the first few can decide; with a plan, those that rows enter through come first.
        order = np.lexsort((-self.shares, late, np.repeat(np.arange(len(self.rep)), self.sizes)))
        self.numbers, self.shares = self.numbers[order], self.shares[order]
        # A term's least share, or an even part of it if it is far above the usual, and how many times as much a question has.
        self.base = np.full(len(self.pairs), np.inf)
        np.minimum.at(self.base, self.numbers, self.shares)
        self.base /= np.ceil(self.base / np.quantile(self.shares, 0.95))
        self.times = np.round(self.shares / self.base[self.numbers], 12)

    def keep(self, q: int, rows: np.ndarray, scores: np.ndarray) -> None:
        """Merge rows, which come in key order, into the question's best; earlier rows win ties."""
        good = scores > self.least[q] if self.full[q] else scores >= self.least[q] - SLACK
        rows, scores = rows[good], scores[good]
        if not len(rows):
            return
        if len(rows) > 4 * self.k:
            good = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            rows, scores = rows[good], scores[good]
        scores, rows = np.concatenate((self.score[q], scores)), np.concatenate((self.row[q], rows))
        best = np.lexsort((rows, -scores))[: self.k]
        self.score[q], self.row[q] = scores[best], rows[best]
        if self.row[q][-1] >= 0:
            self.full[q], self.least[q] = True, max(self.least[q], self.score[q][-1])


class _Block:
    """Postings of some of a cell's rows, numbered from ``start``.

    By row with whole weights, and by term, as a list or, for a frequent term, as a number for each
    row: what the posting adds to a question that has the term once, in units of 1 / ``scale``, rounded up.
    """

    def __init__(self, asked: _Asked, held: list[tuple[np.ndarray, ...]], start: int):
        self.start = start
        size, number, weight = ([part[i] for part in held] for i in range(3))
        held.clear()
        self.size, self.number, self.weight = np.concatenate(size), np.concatenate(number), np.concatenate(weight)
        self.end = np.cumsum(self.size)
        rows = len(self.size)
        place = np.repeat(np.arange(rows), self.size)
        order = np.argsort(self.number.astype(np.int64) << 32 | place)
        self.row, listed = place[order], self.weight[order]
        del place
        many = np.bincount(self.number, minlength=len(asked.pairs))
        self.starts = np.zeros(len(asked.pairs) + 1, np.int64)
        self.starts[1:] = np.cumsum(many)
        held_terms = np.flatnonzero(many)
        self.most = np.zeros(len(asked.pairs))
        if len(held_terms):
            self.most[held_terms] = np.maximum.reduceat(listed, self.starts[held_terms])
        self.bounds = asked.shares * self.most[asked.numbers]
        total = np.add.reduceat(self.bounds, asked.ends - asked.sizes)
        largest = max(np.quantile(total, MOST_QUESTIONS), float((self.most * asked.base).max()), 1e-300)
        self.scale = FULL / largest
        listed *= np.repeat((asked.base * self.scale)[held_terms], many[held_terms])
        self.listed = np.ceil(listed, out=listed).astype(np.uint16)
        frequent = np.flatnonzero(many >= max(2, DENSE * rows))
        self.line = np.full(len(asked.pairs), -1)
        self.line[frequent] = np.arange(len(frequent))
        self.lines = np.zeros((len(frequent), rows), np.uint16)
        for line, term in zip(self.lines, frequent.tolist()):
            span = slice(self.starts[term], self.starts[term + 1])
            line[self.row[span]] = self.listed[span]
        self.sums = {kind: np.zeros(rows, kind) for kind in (np.uint16, np.uint32, np.uint64)}

    def exact(self, asked: _Asked, rows: np.ndarray, own: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Whole scores of ``rows``, each of which has a posting."""
        each = self.size[rows]
        ends = np.cumsum(each)
        at = np.arange(ends[-1]) + np.repeat(self.end[rows] - ends, each)
        asked.query[own] = share
        scores = np.add.reduceat(asked.query[self.number[at]] * self.weight[at], ends - each)
        asked.query[own] = 0.0
        return scores


def _postings(asked: _Asked, rows: pa.Table, weigh: Weigh | None) -> tuple[np.ndarray, ...]:
    """How many terms of the questions each row has, their numbers and weights by row."""
    terms, sizes = _lists(rows.column("terms").combine_chunks())
    place = np.repeat(np.arange(len(sizes)), sizes)
    number = pc.fill_null(pc.index_in(terms, value_set=asked.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    scope = pc.fill_null(pc.index_in(rows.column("scope").combine_chunks(), value_set=asked.scopes), -1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero((number >= 0) & (scope[place] >= 0))
    place = place[good]
    pair = scope[place] * np.int64(len(asked.terms)) + number[good]
    number = np.minimum(np.searchsorted(asked.pairs, pair), len(asked.pairs) - 1)
    known = asked.pairs[number] == pair
    place, number, good = place[known], number[known], good[known]
    if weigh is None:
        weight = _lists(rows.column("numbers").combine_chunks())[0].to_numpy(zero_copy_only=False)[good]
    else:
        times = _lists(rows.column("times").combine_chunks())[0].to_numpy(zero_copy_only=False)
        length = np.bincount(np.repeat(np.arange(len(sizes)), sizes), times, len(sizes))
        # Sums go by a term's number, however the row's terms were listed.
        order = np.argsort(place * len(asked.pairs) + number)
        place, number, good = place[order], number[order], good[order]
        weight = weigh(times[good].astype(np.float64), length[place], asked.average[scope[place]])
    return np.bincount(place, minlength=len(sizes)), number.astype(np.int32), weight


def _score(asked: _Asked, block: _Block, cap: float) -> None:
    """Enter a block's rows into the questions' best rows, some questions at a time.

    A question's terms are read by falling share until the others alone cannot reach its threshold.
    Sums are upper bounds, by at most ``spare`` units; rows whose bound reaches the threshold are scored in full.
    """
    if not len(block.number):
        return
    highest = cap * block.scale
    for first in range(0, len(asked.rep), BOUND_QUESTIONS):
        last = min(first + BOUND_QUESTIONS, len(asked.rep))
        begin, end = int(asked.ends[first] - asked.sizes[first]), int(asked.ends[last - 1])
        sizes = asked.sizes[first:last]
        heads = asked.ends[first:last] - sizes - begin
        numbers, times = asked.numbers[begin:end], asked.times[begin:end]
        # What each term can add, in units; a rounded number is at most one too high each time it is added.
        units = np.where(block.most[numbers] > 0, block.bounds[begin:end] * block.scale + np.ceil(times) + 1.0, 0.0)
        total = np.add.reduceat(units, heads)
        spare = np.add.reduceat(np.ceil(times) + 1.0, heads)
        limit = (asked.least[first:last] - SLACK * (1.0 + np.abs(asked.least[first:last]))) * block.scale - 1.0
        passed = np.cumsum(units) - units
        rest = np.repeat(total + passed[heads], sizes) - passed + 1.0
        needed = (rest >= np.repeat(limit, sizes)) & (units > 0)
        focus = np.maximum.reduceat(np.where(needed, np.arange(len(units)) - np.repeat(heads, sizes) + 1, 0), heads)
        light = np.where(focus < sizes, np.append(rest, 0.0)[heads + focus], 0.0)
        if asked.unread is not None:
            focus = asked.planned[first:last]
            light = np.where(focus < sizes, asked.unread[first:last] * block.scale + spare, 0.0)
        lists = (block.starts[numbers].tolist(), block.starts[numbers + 1].tolist(), block.line[numbers].tolist(), times.tolist())
        for q in np.flatnonzero((total > 0) & (total >= limit)).tolist():
            head = int(heads[q])
            tail = head + int(sizes[q])
            kind = np.uint16 if total[q] < 65_000 else np.uint32 if total[q] < 4e9 else np.uint64
            mine = slice(begin + head, begin + tail)
            rows = _near(block, kind, lists, head, head + int(focus[q]), tail, float(limit[q]), float(light[q]), float(spare[q]), asked.k, highest)
            if len(rows):
                scores = block.exact(asked, rows, asked.numbers[mine], asked.shares[mine])
                asked.keep(first + q, rows + block.start, np.minimum(np.round(scores, 9), cap))


def _add(block: _Block, sums: np.ndarray, lists: tuple[list, ...], first: int, last: int) -> None:
    """Add what the terms ``first`` to ``last`` give to the rows' sums."""
    starts, ends, lines, times = lists
    rows, values = [], []
    for i in range(first, last):
        start, end, line, often = starts[i], ends[i], lines[i], times[i]
        if end == start:
            continue
        more = block.lines[line] if line >= 0 else block.listed[start:end]
        if often != 1.0:
            whole = often == int(often)
            more = np.multiply(more, sums.dtype.type(often), dtype=sums.dtype) if whole else np.ceil(more * often).astype(sums.dtype)
        if line >= 0:
            np.add(sums, more, out=sums)
        else:
            rows.append(block.row[start:end])
            values.append(more)
    if rows:
        np.add.at(sums, np.concatenate(rows), np.concatenate(values).astype(sums.dtype, copy=False))


def _near(
    block: _Block, kind: type, lists: tuple[list, ...], head: int, middle: int, tail: int, limit: float, light: float, spare: float, k: int, highest: float,
) -> np.ndarray:
    """Rows that may be among a question's best: those that reach ``limit`` by its terms up to ``middle`` and what the others can add."""
    sums = block.sums[kind]
    _add(block, sums, lists, head, middle)
    reached = sums >= kind(max(1.0, limit - light))
    if middle < tail and np.count_nonzero(reached) > FEW_ROWS:
        _add(block, sums, lists, middle, tail)
        reached = sums >= kind(max(1.0, limit))
        middle = tail
    rows = np.flatnonzero(reached)
    if middle == tail and len(rows) > k:
        able = sums[rows]
        least = min(float(np.partition(able, len(able) - k)[len(able) - k]) - spare, highest) - 1.0
        rows = rows[able >= kind(max(1.0, least))]
    sums.fill(0)
    return rows


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A cell's rows, some terms at a time; its questions, which come first, in one piece."""
    held, size, limit = [], 0, FIRST_TERMS
    for batch in map(_split, batches):
        asked = int(np.count_nonzero(batch.column("rep").is_valid().to_numpy(zero_copy_only=False)))
        if asked:
            held.append(batch.slice(0, asked))
        if asked < batch.num_rows:
            if held and held[-1].column("rep").null_count == 0:
                yield pa.Table.from_batches(held)
                held = []
            batch = batch.slice(asked)
            sizes = np.cumsum(_lists(batch.column("terms"))[1])
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + limit - size, "right")))
                held.append(batch.slice(start, end - start))
                size += int(sizes[end - 1] - before)
                if size >= limit or end < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held, size, limit = [], 0, SCORED_TERMS
                start = end
    if held:
        yield pa.Table.from_batches(held)


def best_rows(
    rows: DataFrame, asked: DataFrame, k: int, *, key: str, counts: tuple[int, int], weigh: Weigh | None = None,
    floor: float = 0.0, cap: float = float("inf"),
) -> DataFrame:
    """The ``k`` rows of greatest score for each question: rep, key, score.

    ``rows`` has key, scope, distinct terms (a list, or joined by ``BREAK``) and their numbers, or with
    ``weigh`` their ``times``; ``asked`` rep (long), scope, terms, numbers and average.  A score sums,
    over the terms that a row shares with a question of its scope, the question's number times the
    row's weight: its number, or ``weigh(times, all times of the row, average)``.  It is rounded to nine digits and cut to ``cap``;
    rows of score 0 or below ``floor`` are left out, equal scores go by rising key.

    ``asked`` may have a plan: ``cuts`` (a weight for each term), ``unread`` and ``least``.  Rows then
    enter through terms of finite cut, ``unread`` bounds what all weights below the cuts can
    add, and the question's k-th score is known to be ``least`` or more.

    Rows and questions are dealt to cells (``counts``, of both, sets how many), and each cell
    streams its rows past its questions and keeps ``k`` per question.  What is shuffled is rows
    and questions, their terms joined to one string (a term is not empty and has no ``BREAK``), and winners; a pair of a row and a question only exists inside a task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-counts[1] // CELL_QUESTIONS))
    parts = max(1, -(-counts[0] // CELL_ROWS), -(-cores // blocks))
    placed = rows.withColumns({"part": F.pmod(F.xxhash64(key), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    tries = asked.withColumns({"block": F.pmod(F.xxhash64("rep"), F.lit(blocks)), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    cell = (F.col("part") * blocks + F.col("block")).cast("int").alias("cell")
    none = F.lit(None)
    # One string takes half the room of a list of short ones.
    joined = F.nullif(F.array_join("terms", BREAK), F.lit("")).alias("terms")
    times = (F.col("times") if weigh else none).cast("array<int>").alias("times")
    plan = {"cuts": "array<double>", "unread": "double", "least": "double"}
    unplanned = [none.cast(kind).alias(name) for name, kind in plan.items()]
    dealt = placed.select(cell, none.cast("bigint").alias("rep"), key, none.cast("double").alias("average"), "scope",
                         joined if isinstance(rows.schema["terms"].dataType, ArrayType) else "terms", "numbers", times, *unplanned).unionByName(
        tries.select(cell, "rep", none.cast(rows.schema[key].dataType).alias(key), "average",
                     "scope", joined, "numbers", none.cast("array<int>").alias("times"), *(plan if "cuts" in asked.columns else unplanned)))
    # Questions first (they have no key), then rows by key: a row's number orders it by key.
    dealt = dealt.repartitionById(parts * blocks, "cell").sortWithinPartitions(F.col("rep").isNull(), key).drop("cell")
    schema = StructType([StructField("rep", LongType()), StructField(key, rows.schema[key].dataType), StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(batches)
        first = next(pieces, None)
        if first is None or first.column("rep").null_count:
            return
        mine, keys, start, end = _Asked(first, k, floor), [], 0, 0
        held, size, limit = [], 0, FIRST_POSTINGS
        for piece in pieces:
            held.append(_postings(mine, piece, weigh))
            keys.append(piece.column(key).combine_chunks())
            end, size = end + piece.num_rows, size + len(held[-1][1])
            if size >= limit:
                _score(mine, _Block(mine, held, start), cap)
                start, size, limit = end, 0, min(SCORED_POSTINGS, GROWTH * limit)
        if held:
            _score(mine, _Block(mine, held, start), cap)
        if not keys:
            return
        keys = pa.concat_arrays(keys)
        for q in range(0, len(mine.rep), 10_000):
            found = mine.row[q:q + 10_000] >= 0
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(mine.rep[q:q + 10_000], found.sum(axis=1))), keys.take(pa.array(mine.row[q:q + 10_000][found])),
                pa.array(mine.score[q:q + 10_000][found])], names=["rep", key, "score"])

    return dealt.mapInArrow(run, schema)
