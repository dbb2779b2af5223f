"""Page structure: headings, sections, sentence packing, token windows.

Each function works on one row's arrays, so a whole corpus is chunked without a
shuffle: the row is the unit of work and its size is bounded by the download cap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions import fixed_values as fv
from docloom.functions.text import count_tokens, decode, split_sentences, strip, tokens, trimmed
from docloom.session import let

_SUM_BLOCK = 64
_VOCABULARY = f"^(?:{'|'.join(fv.SECTION_VOCABULARY)})$"
# A name and a line end, or a letter more where lower case is longer.
_LONGEST_NAME = 2 * max(len(name) for name in fv.SECTION_VOCABULARY)
# Anchored before the alternatives: a line is tried at its start only.
_MARKED = f"(?U)^(?:{fv.MARKDOWN_HEADING.removeprefix('^')}|{fv.NUMBERED_HEADING.removeprefix('^')})"


def is_heading(line: Column) -> Column:
    """Markdown, numbered, known section name, or a line of capitals."""
    return let(strip(line), _heads)


def _heads(line: Column) -> Column:
    """``is_heading`` of a line that is already stripped; long lines pass the short tests unread."""

    def all_caps(bare: Column) -> Column:
        letters = F.regexp_count(bare, F.lit(r"\p{L}"))
        capitals = F.regexp_count(bare, F.lit(r"\p{Lu}"))
        return (
            (F.length(bare) <= 80)
            & F.upper(bare).rlike(fv.ALL_CAPS_HEADING)
            & (letters >= 4)
            & (capitals / letters >= 0.85)
        )

    bare = F.when(line.endswith(":"), F.regexp_replace(line, ":+$", "")).otherwise(line)
    return (line != "") & (
        line.rlike(_MARKED)
        | let(bare, lambda b: ((F.length(b) <= _LONGEST_NAME) & F.lower(b).rlike(_VOCABULARY)) | all_caps(b))
    )


def _heading_title(line: Column) -> Column:
    bare = strip(F.regexp_replace(line, "^#+", ""))
    return let(
        bare, lambda t: F.when(t.endswith(":"), strip(F.substring(t, 1, F.length(t) - 1))).otherwise(t)
    )


def running_totals(counts: Column) -> Column:
    """For every number the sum of those before it, in time that grows with their count.

    Sums run inside blocks of 64, blocks of blocks and so on, so no sum reads more than 64
    numbers a level (the uppermost: one for every 262,144).  Totals are integers; an empty array has none.
    """
    width = F.lit(_SUM_BLOCK)
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda a, b: a + b)

    def sums(numbers: Column) -> Column:
        blocks = F.ceil(F.size(numbers) / width).cast("int")
        return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(F.transform(
            F.sequence(F.lit(0), blocks - 1), lambda b: total(F.slice(numbers, b * width + 1, width))))

    def before(numbers: Column, i: Column) -> Column:
        inside = F.pmod(i, width)
        return total(F.slice(numbers, i - inside + 1, inside))

    def build(levels: Column) -> Column:
        return F.transform(levels["n0"], lambda n, i: (
            before(levels["n0"], i)
            + before(levels["n1"], F.floor(i / width).cast("int"))
            + before(levels["n2"], F.floor(i / F.lit(_SUM_BLOCK**2)).cast("int"))
            + total(F.slice(levels["n3"], 1, F.floor(i / F.lit(_SUM_BLOCK**3)).cast("int")))
        ))

    return let(counts, lambda n0: let(sums(n0), lambda n1: let(sums(n1), lambda n2: let(
        F.struct(n0.alias("n0"), n1.alias("n1"), n2.alias("n2"), sums(n2).alias("n3")), build))))


_SECTION = "struct<title:string,text:string,start_char:int,end_char:int>"


def page_sections(text: Column) -> Column:
    """Sections of one page as (title, text, start_char, end_char), in order."""

    def build(page: Column) -> Column:
        raw_lines = F.split(F.regexp_replace(page, r"\n\z", ""), "\n")
        lines = F.transform(
            raw_lines,
            lambda raw: let(
                trimmed(raw),
                lambda s: F.struct(
                    s.alias("s"), F.length(raw).alias("n"), _heads(s).alias("head")
                ),
            ),
        )
        return let(lines, lambda ls: cut(page, ls))

    def cut(page: Column, lines: Column) -> Column:
        # Headings start sections; before the first of them the first line with text does.
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        marked = lambda i: F.get(lines, i)["head"] | (F.get(lines, i)["s"] != "")
        first = F.get(F.slice(F.filter(places, marked), 1, 1), F.lit(0))
        starts = let(
            F.struct(running_totals(F.transform(lines, lambda x: x["n"] + 1)).alias("pos"), first.alias("first")),
            lambda c: F.transform(
                F.filter(places, lambda i: F.get(lines, i)["head"] | (i == c["first"])),
                lambda i: F.struct(i.alias("i"), F.get(c["pos"], i).alias("pos"), F.get(lines, i)["head"].alias("head")),
            ),
        )
        return let(starts, lambda st: spans(page, lines, st))

    def spans(page: Column, lines: Column, starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            following = F.get(starts, k + 1)
            stop = F.coalesce(following["i"], F.size(lines))
            end_char = F.least(F.coalesce(following["pos"] - 1, F.length(page)), F.length(page))
            first = start["i"] + F.when(start["head"], 1).otherwise(0)
            body = trimmed(
                F.array_join(
                    F.transform(F.slice(lines, first + 1, stop - first), lambda x: x["s"]), "\n"
                )
            )
            title = F.when(start["head"], _heading_title(F.get(lines, start["i"])["s"]))
            return let(
                F.struct(title.alias("t"), body.alias("b")),
                lambda s: F.struct(
                    s["t"].alias("title"),
                    F.when(s["b"] != "", s["b"]).otherwise(F.coalesce(s["t"], F.lit(""))).alias("text"),
                    start["pos"].alias("start_char"),
                    end_char.alias("end_char"),
                ).cast(_SECTION),
            )

        kept = F.filter(F.transform(starts, one), lambda s: trimmed(s["text"]) != "")
        whole = F.array(
            F.struct(
                F.lit(None).cast("string").alias("title"),
                trimmed(page).alias("text"),
                F.lit(0).alias("start_char"),
                F.length(page).alias("end_char"),
            ).cast(_SECTION)
        )
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))

    empty = F.array().cast(f"array<{_SECTION}>")
    return let(
        F.coalesce(text, F.lit("")),
        lambda page: F.when(trimmed(page) == "", empty).otherwise(build(page)),
    )


def merge_short_sections(sections: Column, min_chars: int = DEFAULT.min_section_chars) -> Column:
    """Fold each section shorter than ``min_chars`` into the one before it on the page."""

    def is_short(section: Column, i: Column) -> Column:
        return (i > 0) & (F.length(trimmed(section["text"])) < min_chars)

    def merge(secs: Column) -> Column:
        keyed = F.transform(
            secs, lambda s, i: F.struct(i.alias("i"), (~is_short(s, i)).alias("lead"))
        )
        leads = F.transform(F.filter(keyed, lambda x: x["lead"]), lambda x: x["i"])

        def group(leaders: Column) -> Column:
            def one(at: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(leaders, k + 1), F.size(secs))
                members = F.slice(secs, at + 1, stop - at)
                first = F.get(members, F.lit(0))
                parts = F.transform(
                    members,
                    lambda m, j: F.when(
                        (j > 0) & (F.coalesce(m["title"], F.lit("")) != ""),
                        F.concat(m["title"], F.lit("\n\n"), m["text"]),
                    ).otherwise(m["text"]),
                )
                return F.struct(
                    first["title"].alias("title"),
                    trimmed(F.array_join(parts, "\n\n")).alias("text"),
                    first["start_char"].alias("start_char"),
                    F.array_max(F.transform(members, lambda m: m["end_char"])).alias("end_char"),
                ).cast(_SECTION)

            return F.transform(leaders, one)

        return let(leads, group)

    return let(sections, lambda s: F.when(F.size(s) == 0, s).otherwise(merge(s)))


def _pack(counts: Column, limit: int) -> Column:
    """Greedy packing: index of the first item of each group whose total stays in ``limit``.

    An item above the limit is a group of its own.
    """
    zero = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("sum"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, n: Column) -> Column:
        begins = (acc["i"] == 0) | (acc["sum"] + n > limit)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(begins, n).otherwise(acc["sum"] + n).alias("sum"),
            F.when(begins, F.array_append(acc["starts"], acc["i"]))
            .otherwise(acc["starts"])
            .alias("starts"),
        )

    return F.aggregate(counts, zero, step, lambda acc: acc["starts"])


def pack_sentences(text: Column, limit: int = DEFAULT.soft_max_tokens) -> Column:
    """Sentences of a section joined into units of at most ``limit`` tokens."""

    def build(sentences: Column) -> Column:
        counted = F.struct(
            sentences.alias("s"), F.transform(sentences, count_tokens).alias("n")
        )
        return let(
            counted,
            lambda c: let(_pack(c["n"], limit), lambda starts: F.transform(
                starts,
                lambda at, k: let(
                    F.coalesce(F.get(starts, k + 1), F.size(c["s"])) - at,
                    lambda length: F.struct(
                        F.array_join(F.slice(c["s"], at + 1, length), " ").alias("text"),
                        F.aggregate(
                            F.slice(c["n"], at + 1, length), F.lit(0), lambda a, b: a + b
                        ).alias("token_count"),
                        length.alias("sentence_count"),
                    ),
                ),
            )),
        )

    return let(split_sentences(text), build)


def token_windows(text: Column, size: int, first_size: int | None = None) -> Column:
    """Consecutive windows of ``size`` tokens; the first may have its own size."""
    head = size if first_size is None else first_size

    def build(toks: Column) -> Column:
        n = F.size(toks)
        last = F.ceil(F.greatest(n - head, F.lit(0)) / size).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.when(i == 0, decode(F.slice(toks, 1, head))).otherwise(
                decode(F.slice(toks, head + (i - 1) * size + 1, size))
            ),
        )

    return let(tokens(text), build)


def cap_text(
    text: Column, limit: int = DEFAULT.max_tokens, first_limit: int | None = None, count: Column | None = None
) -> Column:
    """Pieces of at most ``limit`` tokens, cut at sentences where possible; ``count``: its tokens, if known."""
    head = limit if first_limit is None else first_limit

    def split_long(t: Column) -> Column:
        groups = pack_sentences(t, limit)
        return F.flatten(
            F.transform(
                groups,
                lambda g, i: F.when(g["token_count"] <= limit, F.array(g["text"])).otherwise(
                    F.when(i == 0, token_windows(g["text"], limit, head)).otherwise(
                        token_windows(g["text"], limit)
                    )
                ),
            )
        )

    return let(
        trimmed(text),
        lambda t: F.when(t == "", F.array().cast("array<string>"))
        .when((count_tokens(t) if count is None else count) <= head, F.array(t))
        .otherwise(F.filter(split_long(t), lambda p: trimmed(p) != "")),
    )


def overlap_tail(text: Column, n: int = DEFAULT.overlap_tokens) -> Column:
    """The last ``n`` tokens as text; the whole text when it is shorter."""
    return let(
        tokens(F.coalesce(text, F.lit(""))),
        lambda t: F.when(F.size(t) <= n, F.coalesce(text, F.lit(""))).otherwise(
            decode(F.slice(t, -n, n))
        ),
    )


def with_overlap(pieces: Column, n: int = DEFAULT.overlap_tokens) -> Column:
    """Prefix every piece after the first with the ``n`` tokens that precede it.

    ``pieces`` is a document's ordered array of structs with a ``text`` field.  The tail
    of an already prefixed piece equals the last tokens of everything before it, so the
    recursion closes to a slice of one token stream and needs no fold over outputs.
    """

    def build(stream: Column) -> Column:
        counts = F.transform(stream, lambda toks: F.size(toks))
        return let(
            F.struct(F.flatten(stream).alias("all"), counts.alias("n"), running_totals(counts).alias("before")),
            lambda s: F.transform(
                pieces,
                lambda p, i: let(
                    F.get(s["before"], i),
                    lambda before: let(
                        F.least(before, F.lit(n)),
                        lambda tail: F.struct(
                            # Only the tail is put together again from tokens.
                            F.when(tail == 0, trimmed(p["text"])).otherwise(
                                trimmed(F.concat(decode(F.slice(s["all"], before - tail + 1, tail)), F.lit("\n"), trimmed(p["text"])))
                            ).alias("text"),
                            (tail + F.get(s["n"], i)).alias("token_count"),
                        ),
                    ),
                ),
            ),
        )

    stream = F.transform(
        pieces, lambda p, i: tokens(F.when(i > 0, F.concat(F.lit("\n"), trimmed(p["text"])))
                                    .otherwise(p["text"]))
    )
    return let(stream, build)


def batch_starts(lengths: Column, size: int, max_chars: int) -> Column:
    """Greedy request batches over ordered text lengths: index of each batch's first item."""
    zero = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("count"),
        F.lit(0).cast("bigint").alias("chars"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, n: Column) -> Column:
        begins = (
            (acc["count"] == 0)
            | (n > max_chars)
            | (acc["count"] >= size)
            | (acc["chars"] + n > max_chars)
        )
        alone = n > max_chars
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(alone, 0).when(begins, 1).otherwise(acc["count"] + 1).alias("count"),
            F.when(alone, F.lit(0).cast("bigint"))
            .when(begins, n.cast("bigint"))
            .otherwise(acc["chars"] + n)
            .alias("chars"),
            F.when(begins, F.array_append(acc["starts"], acc["i"]))
            .otherwise(acc["starts"])
            .alias("starts"),
        )

    return F.aggregate(lengths, zero, step, lambda acc: acc["starts"])
