"""Normalisation, tokens, sentences and line-level cleaning of text columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import fixed_values as fv
from docloom.session import let

# Unicode white space, spelled out because \s alone is ASCII-only in the JVM.
SPACE = r"[\s\p{Z}]"
TOKEN_CORE = r"(?:\p{L}+|\p{N}{1,3}|[^\s\p{Z}\p{L}\p{N}]+)"
TOKEN = SPACE + "*" + TOKEN_CORE


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.WHITESPACE))


def trimmed(text: Column) -> Column:
    """``strip`` for long text: Spark's trim reads a whole string, and most begin and end in printable ASCII.

    Strings compare by bytes, so two comparisons tell the kind of the first byte; the last byte
    is one of the binary form.
    """

    def cut(t: Column) -> Column:
        last = F.substring(t.cast("binary"), -1, 1)
        printable = (t >= "!") & (t < "\x7f") & (last > F.lit(b" ")) & (last < F.lit(b"\x7f"))
        return F.when(printable, t).otherwise(strip(t))

    return let(text, cut)


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE + "+", " "))


def either(words, *, word_bounded: bool = True) -> str:
    """Pattern for any of ``words`` (a raw alternation or a list of literals)."""
    body = words if isinstance(words, str) else "|".join(re.escape(w) for w in words)
    return rf"(?U)\b(?:{body})\b" if word_bounded else rf"(?:{body})"


# --- normalisation --------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; the one step Spark has no built-in for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_page_text(text: Column, *, compose: bool = True) -> Column:
    """NFC, line ends to LF, control characters out, runs of space to one, lines stripped."""
    out = nfc(text) if compose else text
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"[\s\p{Z}&&[^\n]]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.coalesce(strip(out), F.lit(""))


# --- tokens ---------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Tokens with their leading space, so that joining any run gives the text back."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_CORE)), F.lit(0))


def decode(token_array: Column) -> Column:
    return F.array_join(token_array, "")


def words(text: Column, min_len: int, stop=()) -> Column:
    """Lower-case ASCII words of at least ``min_len`` characters, duplicates kept.

    Stop words are part of the pattern, so one regex pass does both.
    """
    word = rf"[a-z0-9]{{{min_len},}}"
    if stop:
        word = rf"(?<![a-z0-9])(?!(?:{'|'.join(stop)})(?![a-z0-9])){word}"
    return F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))


def text_array(values) -> Column:
    """A constant array from one literal; the optimiser folds the split away."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def lexical_tokens(text: Column) -> Column:
    return words(text, 3, fv.LEXICAL_STOP)


def gate_terms(text: Column) -> Column:
    return F.array_distinct(words(text, 4, fv.GATE_STOP))


def title_terms(text: Column) -> Column:
    return F.array_distinct(words(text, 4, fv.TITLE_STOP))


def lexical_tokens_py(text: str) -> list[str]:
    """The same split for one question held by the driver."""
    return [t for t in re.findall(r"[a-z0-9]{3,}", text.lower()) if t not in fv.LEXICAL_STOP]


def overlap_share(terms: Column, body: Column) -> Column:
    """Share of ``terms`` that occur as substrings of ``body`` (0 without terms)."""
    return let(
        F.struct(terms.alias("q"), F.lower(F.coalesce(body, F.lit(""))).alias("b")),
        lambda s: F.when(F.size(s["q"]) == 0, F.lit(0.0)).otherwise(
            F.size(F.filter(s["q"], lambda t: F.contains(s["b"], t))).cast("double")
            / F.size(s["q"])
        ),
    )


# --- sentences ------------------------------------------------------------------------

_GUARD = "|".join(re.escape(a[:-1]) for a in fv.ABBREVIATIONS)
SENTENCE_BREAK = (
    rf"(?<=[.!?])(?<!(?<![\p{{L}}\p{{N}}_])(?:{_GUARD})\.){SPACE}+(?=[^\s\p{{Z}}])"
)

_BREAK = "\x02"


def split_sentences(text: Column) -> Column:
    """Sentences in order; a blank line always ends one, an abbreviation never does."""
    paragraphs = F.split(trimmed(text), rf"\n{SPACE}*\n")
    parts = F.flatten(F.transform(paragraphs, lambda p: let(trimmed(p), _parted)))
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def _parted(paragraph: Column) -> Column:
    """Split at sentence breaks by way of a mark: Spark compiles a pattern to split by for every value."""
    marked = F.split(F.regexp_replace(paragraph, SENTENCE_BREAK, _BREAK), _BREAK)
    return F.when(F.contains(paragraph, F.lit(_BREAK)), F.split(paragraph, SENTENCE_BREAK)).otherwise(marked)


# --- boilerplate ----------------------------------------------------------------------

DROP_LINE = (
    rf"(?i)^(?:{fv.ARTICLE_ID_LINE}|keywords(?:[^\p{{L}}\p{{N}}_]|$)|"
    + "|".join(fv.SKIP_LINE_STARTS)
    + ")"
)
# Every phrase begins with one of a few pairs of letters; other places are passed at once.
_BEGINNINGS = {phrase[:2] for phrase in fv.UI_BOILERPLATE_PATTERN.split("|")}
BOILERPLATE = "(?i)(?=[{}][{}])(?:{})".format(
    *("".join(sorted({b[i] for b in _BEGINNINGS})) for i in (0, 1)), fv.UI_BOILERPLATE_PATTERN
)


def sanitize(text: Column) -> Column:
    """Page text without share, citation and sidebar lines; prose kept in order."""

    def clean(raw: Column) -> Column:
        lines = F.transform(F.split(raw, r"\n+"), trimmed)
        kept = F.filter(
            lines,
            lambda ln: (ln != "")
            & ~ln.rlike(DROP_LINE)
            & ~((F.length(ln) < 200) & ln.rlike(BOILERPLATE)),
        )
        inline = raw
        for pattern in fv.INLINE_NOISE:
            inline = F.regexp_replace(inline, f"(?i){pattern}", "")
        inline = trimmed(F.regexp_replace(inline, SPACE + "{2,}", " "))
        return let(
            trimmed(F.array_join(kept, "\n\n")), lambda out: F.when(out != "", out).otherwise(inline)
        )

    return let(trimmed(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))), clean)


def truncate_topic(title: Column, max_len: int) -> Column:
    """Cut to ``max_len`` characters, the last one an ellipsis."""
    return let(
        strip(title),
        lambda t: F.when(F.length(t) <= max_len, t).otherwise(
            F.concat(
                F.rtrim(F.substring(t, 1, max_len - 3), F.lit(fv.WHITESPACE)), F.lit("…")
            )
        ),
    )


def whole_words(text: Column, stop) -> Column:
    """Words of four or more characters that no other word character touches."""
    edge = "[A-Za-z0-9_]"
    word = rf"(?<!{edge})(?!(?:{'|'.join(stop)})(?!{edge}))[a-z0-9]{{4,}}(?!{edge})"
    return F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))


# --- snippet for highlighting ---------------------------------------------------------


def best_snippet(excerpt: Column, question: Column, max_len: int = 160) -> Column:
    """The sentence sharing most words with the question, first one on ties."""

    def terms(c: Column) -> Column:
        return whole_words(c, fv.FRAGMENT_STOP)

    def choose(s: Column) -> Column:
        sentences = F.filter(F.split(s["ex"], rf"(?<=[.!?]){SPACE}+"), lambda x: strip(x) != "")
        scored = F.transform(
            sentences,
            lambda x, i: let(
                terms(x),
                lambda t: F.struct(
                    F.when(F.size(t) == 0, F.lit(-1))
                    .otherwise(
                        F.size(F.filter(t, lambda w: F.array_contains(s["q"], w))) * 10
                        - F.when((F.length(x) < 40) | (F.length(x) > 240), 1).otherwise(0)
                    )
                    .alias("score"),
                    (-i).alias("rank"),
                    x.alias("text"),
                ),
            ),
        )
        best = F.array_max(scored)
        chosen = F.when(
            (F.size(s["q"]) > 0) & (F.coalesce(best["score"], F.lit(-1)) > -1), best["text"]
        ).otherwise(s["ex"])
        return F.substring(chosen, 1, max_len)

    return let(
        F.struct(
            collapse_space(F.coalesce(excerpt, F.lit(""))).alias("ex"),
            F.array_distinct(terms(question)).alias("q"),
        ),
        choose,
    )


def text_fragment(excerpt: Column, question: Column) -> Column:
    """URL fragment that highlights the first and last six words of the best snippet."""

    def build(snippet: Column) -> Column:
        parts = F.filter(F.split(snippet, " "), lambda w: w != "")

        def encode(c: Column) -> Column:
            return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))

        single = F.substring(snippet, 1, 140)
        return F.when(
            F.size(parts) < 6,
            F.when(single == "", F.lit("")).otherwise(F.concat(F.lit("#:~:text="), encode(single))),
        ).otherwise(
            F.concat(
                F.lit("#:~:text="),
                encode(F.array_join(F.slice(parts, 1, 6), " ")),
                F.lit(","),
                encode(F.array_join(F.slice(parts, -6, 6), " ")),
            )
        )

    return let(collapse_space(best_snippet(excerpt, question, 220)), build)


def is_follow_up(question: Column, anchor: Column) -> Column:
    """True when a question plausibly narrows the one that needed clarification."""

    def terms(c: Column) -> Column:
        return F.array_distinct(whole_words(c, fv.FOLLOW_UP_STOP))

    prefix = F.substring(F.lower(strip(anchor)), 1, 48)
    return let(
        F.struct(terms(question).alias("a"), terms(anchor).alias("b"), prefix.alias("p")),
        lambda s: (F.size(s["a"]) > 0)
        & (F.size(s["b"]) > 0)
        & (
            (F.size(F.array_intersect(s["a"], s["b"])) >= 2)
            | ((F.length(s["p"]) > 12) & F.contains(F.lower(strip(question)), s["p"]))
        ),
    )
