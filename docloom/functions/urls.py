"""Link tests, link repair and listing-policy checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.text import strip


def _replacement(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def resolve_source_url(url: Column) -> Column:
    cleaned = strip(F.coalesce(url, F.lit("")))
    return F.coalesce(_replacement(fv.URL_REPLACEMENTS, cleaned), cleaned)


def patched_title(url: Column, title: Column) -> Column:
    """Title of a document whose link was repaired; others keep theirs."""
    return F.coalesce(_replacement(fv.TITLE_BY_URL, _replacement(fv.URL_REPLACEMENTS, url)), title)


def is_legacy_fixture_url(url: Column) -> Column:
    return strip(url).rlike(fv.LEGACY_FIXTURE_URL)


def is_article_url(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(f"(?i){fv.ARTICLE_URL}")


def content_type(url: Column) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.when(path.endswith(".pdf"), F.lit("pdf")).otherwise(F.lit("html"))


def is_pdf_content(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def query_parameter(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(""))


def policy_violation(url: Column) -> Column:
    """First listing-policy parameter that is missing or wrong; NULL when compliant."""
    return F.coalesce(
        *[
            F.when(query_parameter(url, name) != value, F.lit(name))
            for name, value in fv.LISTING_POLICY.items()
        ]
    )


def require_policy(url: Column) -> Column:
    return F.when(policy_violation(url).isNull(), url).otherwise(
        F.raise_error(F.concat(F.lit("listing URL must set "), policy_violation(url)))
    )


def page_url(url: Column, page: Column) -> Column:
    """The listing address with ``page`` set (or removed for the first page)."""
    base = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~p.startswith("page=") & F.contains(p, F.lit("="))
    )
    params = F.when(
        page > 1, F.array_append(kept, F.concat(F.lit("page="), page.cast("string")))
    ).otherwise(kept)
    joined = F.array_join(params, "&")
    return F.when(joined == "", base).otherwise(F.concat(base, F.lit("?"), joined))


def absolute_url(base: str, href: Column) -> Column:
    """Resolve a link against a site root."""
    scheme = base.split(":", 1)[0]
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(href, r"^(?:\./)+", "")))
    )
