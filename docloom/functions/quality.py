"""Personal-data screening, noise tests and title repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.text import BOILERPLATE, sanitize, strip, text_array, trimmed
from docloom.session import let


# Kinds with four digits in a row, and letters that a match must begin with: both are cheap to
# test, the word boundary in front of the patterns is not.
_NUMBERS = ("aadhaar", "pan", "phone")
_FIRST = {"aadhaar": r"(?=\d)", "phone": "(?=[+6-9])", "credential": "(?=[pas][ape])"}


def pii_violations(text: Column) -> Column:
    """Ordered array of the personal-data classes found in ``text``."""
    checks = []
    for label, pattern, ignore_case in fv.PII_PATTERNS:
        hit = text.rlike(("(?iU)" if ignore_case else "(?U)") + _FIRST.get(label, "") + pattern)
        if label == "email":
            hit = F.contains(text, F.lit("@")) & hit
        elif label in _NUMBERS:
            hit = text.rlike(r"(?U)\d{4}") & hit
        checks.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*checks))


def is_clean(text: Column) -> Column:
    return F.size(pii_violations(text)) == 0


def reject_if_pii(text: Column) -> Column:
    """Pass clean text through; fail the query on the first dirty row."""
    return let(
        pii_violations(text),
        lambda v: F.when(F.size(v) == 0, text).otherwise(
            F.raise_error(F.concat(F.lit("PII detected: "), F.array_join(v, ", ")))
        ),
    )


def is_placeholder(text: Column) -> Column:
    # Both phrases begin with one of two letters; other places are passed at once.
    begins = "".join(sorted({phrase[0] for phrase in fv.PLACEHOLDER_PATTERN.split("|")}))
    return F.coalesce(text, F.lit("")).rlike(f"(?iU)(?=[{begins}])(?:{fv.PLACEHOLDER_PATTERN})")


def _noise(text: Column, short_is_noise: bool) -> Column:
    def shrunk(t: Column, n: Column) -> Column:
        return n < F.greatest(F.lit(120.0), F.length(t) * F.lit(0.35))

    def test(t: Column) -> Column:
        furniture = F.substring(t, 1, 800).rlike(BOILERPLATE)
        if short_is_noise:
            return (t == "") | let(
                F.length(sanitize(t)), lambda n: (n < 80) | (furniture & shrunk(t, n))
            )
        # Only text that shows page furniture is cleaned to see how much prose is left.
        return (t == "") | (furniture & shrunk(t, F.length(sanitize(t))))

    return let(trimmed(F.coalesce(text, F.lit(""))), test)


def is_explicit_noise(text: Column) -> Column:
    return _noise(text, short_is_noise=False)


def is_boilerplate(text: Column) -> Column:
    return _noise(text, short_is_noise=True)


def is_low_quality_title(title: Column) -> Column:
    return let(
        strip(F.coalesce(title, F.lit(""))),
        lambda t: (F.length(t) < 8)
        | t.rlike(f"(?iU){fv.FILE_SIZE_TITLE}")
        | F.lower(t).isin(*fv.GENERIC_TITLES),
    )


def resolve_title(title: Column, url: Column, text: Column) -> Column:
    """Keep a usable title; else a fixed label, the first long line, or a default."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip
    )
    long_lines = F.filter(lines, lambda ln: (F.length(ln) >= 24) & ~ln.rlike(r"^\p{Nd}+$"))
    legacy = F.lit(False)
    for host in fv.LEGACY_HOSTS:
        legacy = legacy | F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(host))
    return let(
        strip(F.coalesce(title, F.lit(""))),
        lambda t: F.when(~is_low_quality_title(t), t)
        .when(legacy, F.lit(fv.LEGACY_TITLE))
        .otherwise(
            F.coalesce(
                F.substring(F.get(long_lines, F.lit(0)), 1, 140),
                F.when(t != "", t),
                F.lit(fv.DEFAULT_TITLE),
            )
        ),
    )


def is_low_quality_chunk(title: Column, url: Column, text: Column) -> Column:
    return is_low_quality_title(resolve_title(title, url, text)) | (
        F.length(strip(F.coalesce(text, F.lit("")))) < 40
    )


def is_answerable(text: Column) -> Column:
    """Not a placeholder, not boilerplate, and at least 80 characters of prose."""
    return ~is_placeholder(text) & ~is_boilerplate(text)


def in_portfolio(url: Column) -> Column:
    return F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(fv.ARTICLE_LINK))


def is_portfolio_document(source_org: Column, url: Column, local_path: Column) -> Column:
    path = F.lower(F.coalesce(local_path, F.lit("")))
    return (
        (source_org == "Nature")
        | in_portfolio(url)
        | (F.contains(path, F.lit("/corpus/nature/")) & path.endswith(".html"))
    )


def refuses(answer: Column, cited: Column) -> Column:
    """True when an answer admits that the corpus does not cover the question."""
    lower = F.lower(strip(F.coalesce(answer, F.lit(""))))
    return let(
        lower,
        lambda a: (a == "")
        | F.exists(text_array(fv.REFUSAL_MARKERS), lambda m: F.contains(a, m))
        | ((F.size(cited) == 0) & ~F.contains(a, F.lit(fv.REFUSAL_SELF_MARK))),
    )
