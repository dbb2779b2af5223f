"""SQL building blocks for the oracles: the derived tables and text functions in DuckDB.

They state the semantics a second time, in another engine and mostly in another shape.
"""

from __future__ import annotations

from docloom.functions import fixed_values as fv

WS = fv.WHITESPACE
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"
TOKEN_CORE = r"(?:\p{L}+|\p{N}{1,3}|[^\s\p{Z}\p{L}\p{N}]+)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WS)})"


def has_word(x: str, alternatives: str) -> str:
    """Unicode-aware word match without look-around."""
    return f"regexp_matches({x}, {lit(f'(?:^|{NOT_WORD})(?:{alternatives})(?:{NOT_WORD}|$)')})"


def words(x: str, min_len: int, stop=()) -> str:
    found = f"regexp_extract_all(lower({x}), '[a-z0-9]{{{min_len},}}')"
    return f"list_filter({found}, lambda w: w not in {inlist(stop)})" if stop else found


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(SPACE + '*' + TOKEN_CORE)})"


def count_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(TOKEN_CORE)}))"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {lit(SPACE + '+')}, ' ', 'g')")


DROP_LINE = (
    rf"(?i)^(?:{fv.ARTICLE_ID_LINE}|keywords(?:[^\p{{L}}\p{{N}}_]|$)|"
    + "|".join(fv.SKIP_LINE_STARTS) + ")"
)
BOILERPLATE = rf"(?i)(?:{fv.UI_BOILERPLATE_PATTERN})"


def sanitize(x: str) -> str:
    inline = "r"
    for pattern in fv.INLINE_NOISE:
        inline = f"regexp_replace({inline}, {lit('(?i)' + pattern)}, '', 'g')"
    inline = strip(f"regexp_replace({inline}, {lit(SPACE + '{2,}')}, ' ', 'g')")
    kept = (
        f"list_filter(list_transform(regexp_split_to_array(r, '\\n+'), lambda l: {strip('l')}), "
        f"lambda l: l <> '' and not regexp_matches(l, {lit(DROP_LINE)}) "
        f"and not (length(l) < 200 and regexp_matches(l, {lit(BOILERPLATE)})))"
    )
    joined = strip(f"array_to_string({kept}, chr(10) || chr(10))")
    raw = strip(f"replace(coalesce({x}, ''), chr(13) || chr(10), chr(10))")
    return let(raw, "r", let(joined, "o", f"case when o <> '' then o else {inline} end"))


def is_placeholder(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {lit('(?i)' + fv.PLACEHOLDER_PATTERN)})"


def _noise(x: str, short: bool) -> str:
    shrunk = (
        f"(regexp_matches(left(t, 800), {lit(BOILERPLATE)}) "
        f"and length(c) < greatest(120.0, length(t) * 0.35))"
    )
    verdict = f"(length(c) < 80 or {shrunk})" if short else shrunk
    return let(strip(f"coalesce({x}, '')"), "t", f"(t = '' or {let(sanitize('t'), 'c', verdict)})")


def is_explicit_noise(x: str) -> str:
    return _noise(x, False)


def is_boilerplate(x: str) -> str:
    return _noise(x, True)


def low_title(x: str) -> str:
    return let(
        strip(f"coalesce({x}, '')"), "lt",
        f"(length(lt) < 8 or regexp_matches(lt, {lit('(?i)' + fv.FILE_SIZE_TITLE)}) "
        f"or lower(lt) in {inlist(fv.GENERIC_TITLES)})",
    )


def resolve_title(title: str, url: str, text: str) -> str:
    first = (
        f"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '\\r?\\n'), "
        f"lambda l: {strip('l')}), lambda l: length(l) >= 24 and not regexp_matches(l, '^[0-9]+$'))[1]"
    )
    legacy = " or ".join(f"contains(lower(coalesce({url}, '')), {lit(h)})" for h in fv.LEGACY_HOSTS)
    return (
        f"case when not {low_title(title)} then {strip(title)} when {legacy} then {lit(fv.LEGACY_TITLE)} "
        f"else coalesce(left({first}, 140), nullif({strip(f'coalesce({title}, {lit(str())})')}, ''), "
        f"{lit(fv.DEFAULT_TITLE)}) end"
    )


# Look-around-free forms of the personal-data patterns.
PII = {
    "aadhaar": rf"(?:^|{NOT_WORD})\d{{4}}[\s-]?\d{{4}}[\s-]?\d{{4}}(?:{NOT_WORD}|$)",
    "pan": rf"(?i)(?:^|{NOT_WORD})[A-Z]{{5}}\d{{4}}[A-Z](?:{NOT_WORD}|$)",
    "phone": rf"[6-9]\d{{9}}(?:{NOT_WORD}|$)",
    "email": (
        rf"(?:(?:^|{NOT_WORD})[A-Za-z0-9_]|[\p{{L}}\p{{N}}_][.%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+"
        rf"\.[A-Za-z|]+(?:[A-Za-z](?:{NOT_WORD}|$)|\|[\p{{L}}\p{{N}}_])"
    ),
    "credential": (
        rf"(?i)(?:^|{NOT_WORD})(password|passwd|api[_-]?key|secret[_-]?key)\s*[:=]\s*\S+"
    ),
}


def pii(x: str) -> str:
    cases = ", ".join(
        f"case when regexp_matches({x}, {lit(p)}) then {lit(label)} end" for label, p in PII.items()
    )
    return f"list_filter([{cases}], lambda v: v is not null)"


# --- derived tables -------------------------------------------------------------------

_TITLE = strip("split_part(text, chr(10), 1)")

CTES = {
    "base": f"""
        select *, case doc_id % 5 when 0 then 'DHR' when 1 then 'ICMR' else 'Nature' end as source_org,
               {_TITLE} as document_title
        from documents""",
    "linked": """
        select *, case source_org
            when 'Nature' then 'https://www.nature.com/articles/s41467-026-' || lpad(doc_id::varchar, 7, '0') || '-' || (doc_id % 10)
            when 'DHR' then 'https://htain.dhr.gov.in/docs/' || doc_id || '.pdf'
            else 'https://www.icmr.gov.in/reports/' || doc_id end as source_url
        from base""",
    "full_catalog": f"""
        select *,
            'sha256:' || left(sha256(lower({strip('source_url')}) || '|' || lower({strip('document_title')})), 16) as document_id,
            case when doc_id % 41 = 7 then '2026-13-40'
                 else strftime(date '2026-06-01' - (doc_id % 30)::int, '%Y-%m-%d') end as publication_date,
            '2026-06-0' || (doc_id % 9 + 1) || 'T' || lpad((doc_id % 24)::varchar, 2, '0') || ':00:00Z' as ingested_at,
            case when source_org = 'DHR' then 'pdf' else 'html' end as content_type
        from linked""",
    "catalog": """
        select doc_id, document_id, source_org, source_url, document_title, publication_date, ingested_at,
            content_type, 'data/corpus/' || lower(source_org) || '/' || replace(document_id, ':', '_') || '.' || content_type as local_path
        from full_catalog""",
    "chunks": """
        select document_id || '::p0001::c0001' as chunk_id, document_id, source_org, source_url, document_title,
            left(publication_date, 4)::int as publication_year, 1 as page_number, 1 as chunk_index,
            text as exact_context, 'unverified' as verification_status, sha256(text) as content_hash,
            doc_id, lang, source
        from full_catalog""",
    "cleaned": f"""
        select * replace ({sanitize(strip('exact_context'))} as exact_context) from chunks""",
    "usable": f"""
        select * replace ({resolve_title('document_title', 'source_url', 'exact_context')} as document_title)
        from cleaned
        where exact_context <> '' and not {is_placeholder('exact_context')} and not {is_boilerplate('exact_context')}""",
    "corpus": f"""
        select *, {words("document_title || ' ' || exact_context", 3, fv.LEXICAL_STOP)} as tokens
        from usable
        where not ({low_title('document_title')} and length(exact_context) < 60)
          and len({words("document_title || ' ' || exact_context", 3, fv.LEXICAL_STOP)}) > 0""",
    "structured": """
        select *, replace(text, chr(10), case doc_id % 4
            when 0 then chr(10) || 'RESULTS:' || chr(10)
            when 1 then chr(10) || chr(10) || '2.1 Findings' || chr(10)
            when 2 then chr(10) || '## Notes on dosing' || chr(10)
            else chr(10) end) as body
        from full_catalog""",
    "questions": """
        select c.conv_id * 100 + c.turn as qid, c.conv_id, c.turn, d.document_id,
            case (c.conv_id + c.turn) % 10
            when 0 then 'how many articles were published on nature on ' || d.publication_date
            when 1 then 'Show nature articles published on ' || d.publication_date
            when 2 then 'list articles published on ' || d.publication_date || ' about ' || split_part(d.document_title, ' ', 2)
            when 3 then 'Summarize the clinical findings of ' || d.document_title
            when 4 then d.document_title || ' treatment. Published: ' || d.publication_date
            when 5 then c.text
            when 6 then 'How much pizza can a kid eat with ' || c.text
            when 7 then 'Which treatment is described for ' || d.document_title
            when 8 then 'quantum computing of ' || c.text
            else 'Explain the health research on ' || split_part(d.text, chr(10), 2) end as question
        from conversations c join full_catalog d on c.conv_id = d.doc_id
        where c.role = 'user'""",
}
NEEDS = {
    "base": (), "linked": ("base",), "full_catalog": ("linked",), "catalog": ("full_catalog",),
    "chunks": ("full_catalog",), "cleaned": ("chunks",), "usable": ("cleaned",),
    "corpus": ("usable",), "structured": ("full_catalog",), "questions": ("full_catalog",),
}


def register(name: str, sql: str, *needs: str) -> None:
    CTES[name], NEEDS[name] = sql, needs


def query(body: str, *needs: str, recursive: bool = False, extra: str = "") -> str:
    """A statement with the derived tables it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        add(need)
    parts = [f"{n} as materialized ({CTES[n]})" for n in ordered]
    if extra:
        parts.append(extra)
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"
