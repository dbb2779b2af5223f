"""Date extraction; an impossible calendar date is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.text import text_array
from docloom.session import let

_MONTH = "|".join(fv.MONTHS)


def _make(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"),
                    F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _month_number(name: Column) -> Column:
    return F.array_position(text_array(fv.MONTHS), name).cast("string")


def question_date(question: Column) -> Column:
    """``2026-06-01``, ``1 june 2026`` or ``june 1, 2026`` inside free text."""
    iso = r"(\d{4})-(\d{2})-(\d{2})"
    day_first = rf"(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})"
    month_first = rf"({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})"

    def part(text: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    return let(
        F.lower(question),
        lambda q: F.when(
            q.rlike(iso), _make(part(q, iso, 1), part(q, iso, 2), part(q, iso, 3))
        )
        .when(
            q.rlike(day_first),
            _make(part(q, day_first, 3), _month_number(part(q, day_first, 2)), part(q, day_first, 1)),
        )
        .when(
            q.rlike(month_first),
            _make(
                part(q, month_first, 3), _month_number(part(q, month_first, 1)),
                part(q, month_first, 2),
            ),
        ),
    )


def stated_publication_date(question: Column) -> Column:
    """First of three written forms that parses, each tried with three formats."""

    def parse(raw: Column) -> Column:
        return F.coalesce(
            F.try_to_date(raw, "d MMMM yyyy"),
            F.try_to_date(raw, "d MMM yyyy"),
            F.try_to_date(raw, "yyyy-MM-dd"),
        )

    def tidy(raw: Column) -> Column:
        return F.initcap(F.regexp_replace(raw, r"\s+", " "))

    forms = (
        r"(?iU)published:\s*(\d{1,2}\s+\w+\s+\d{4})",
        r"(?iU)\b(\d{4}-\d{2}-\d{2})\b",
        r"(?iU)\b(\d{1,2}\s+\w+\s+\d{4})\b",
    )
    return F.coalesce(*[parse(tidy(F.regexp_extract(question, f, 1))) for f in forms])


def catalog_date(value: Column) -> Column:
    return F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")


def publication_year(value: Column) -> Column:
    return F.split_part(value, F.lit("-"), F.lit(1)).cast("int")


def parse_instant(value: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


def year_as_date(text: Column, default: str | None) -> Column:
    """``20xx`` anywhere in the text as the first of June of that year."""
    year = F.regexp_extract(F.coalesce(text, F.lit("")), r"20\d{2}", 0)
    return F.when(year != "", F.concat(year, F.lit("-06-01"))).otherwise(F.lit(default))


def listing_date(text: Column) -> Column:
    """A full date in the text, else its year, else NULL."""
    full = F.regexp_extract(F.coalesce(text, F.lit("")), r"20\d{2}-\d{2}-\d{2}", 0)
    return F.when(full != "", full).otherwise(year_as_date(text, None))


def human_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")
