"""Queries of the chunking layer, from page structure to chunk records and their index."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import html, structure
from docloom.functions.text import strip
from docloom.operators import chunking
from docloom.workload import duck, tables
from docloom.workload.text_queries import sentences_sql

QUERIES, ORACLES = {}, {}
CREATED = "2026-06-02T00:00:00Z"


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def with_structure(spark, sf):
    return chunking.single_page(tables.chunk_source(spark, sf))


def exploded(rows, column, number):
    """Array entries as ``x`` with a 1-based number; the array is evaluated once."""
    out = rows.select("doc_id", F.posexplode_outer(column).alias("_i", "x"))
    return out.filter(F.col("_i").isNotNull()).select(
        "doc_id", (F.col("_i") + 1).cast("bigint").alias(number), "x"
    )


# --- oracles --------------------------------------------------------------------------

_HEAD = f"""(s <> '' and (regexp_matches(s, {duck.lit(fv.MARKDOWN_HEADING)}) or regexp_matches(s, {duck.lit(fv.NUMBERED_HEADING)})
    or lower(bare) in {duck.inlist(fv.SECTION_VOCABULARY)}
    or (regexp_matches(upper(bare), {duck.lit(fv.ALL_CAPS_HEADING)}) and length(bare) <= 80
        and len(regexp_extract_all(bare, '\\p{{L}}')) >= 4
        and len(regexp_extract_all(bare, '\\p{{Lu}}')) / len(regexp_extract_all(bare, '\\p{{L}}')) >= 0.85)))"""
_T = duck.strip("regexp_replace(s, '^#+', '')")

duck.register("lines", f"""
    select *, {_HEAD} as head from (
        select *, {duck.strip('raw')} as s, regexp_replace({duck.strip('raw')}, ':+$', '') as bare from (
            select doc_id, unnest(l) as raw, generate_subscripts(l, 1) as i from (
                select doc_id, string_split(regexp_replace(body, '\\n$', ''), chr(10)) as l from structured
                where {duck.strip('body')} <> '')))""", "structured")
duck.register("segments", """
    select *, coalesce(sum(length(raw) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as off,
        sum(head::int) over (partition by doc_id order by i) as seg from lines""", "lines")
duck.register("raw_sections", f"""
    select doc_id, seg, case when max(head::int) = 1 then regexp_replace(max(case when head then {_T} end), '\\s*:$', '') end as title,
        {duck.strip("coalesce(string_agg(case when not head then s end, chr(10) order by i), '')")} as body,
        min(case when head or s <> '' then off end) as start_char, max(off + length(raw)) as end_char
    from segments group by doc_id, seg""", "segments")
duck.register("sections", """
    select doc_id, row_number() over (partition by doc_id order by seg) as k, title,
        case when body <> '' then body else coalesce(title, '') end as text, start_char, end_char
    from raw_sections where body <> '' or coalesce(title, '') <> ''""", "raw_sections")
duck.register("merged", f"""
    select doc_id, row_number() over (partition by doc_id order by grp) as k, title, text, start_char, end_char from (
        select doc_id, grp, arg_min(title, k) filter (where lead) as title,
            {duck.strip("string_agg(case when not lead and coalesce(title, '') <> '' then title || chr(10) || chr(10) || text else text end, chr(10) || chr(10) order by k)")} as text,
            min(start_char) as start_char, max(end_char) as end_char
        from (select *, sum(lead::int) over (partition by doc_id order by k) as grp
              from (select *, k = 1 or length({duck.strip('text')}) >= 20 as lead from sections))
        group by doc_id, grp)""", "sections")


def packed_sql(source: str, keys: str, limit: int) -> str:
    """Greedy packing as a left fold over a list of structs."""
    return f"""
    select {keys}, ss, nn, list_reduce(
        list_transform(nn, lambda n, i: {{'n': n, 'i': i, 'sum': n, 'starts': [i]}}),
        lambda a, x: case when a.sum + x.n > {limit}
            then {{'n': x.n, 'i': x.i, 'sum': x.n, 'starts': list_append(a.starts, x.i)}}
            else {{'n': x.n, 'i': x.i, 'sum': a.sum + x.n, 'starts': a.starts}} end).starts as starts
    from (select {keys}, ss, list_transform(ss, lambda s: {duck.count_tokens('s')}::bigint) as nn
          from (select {keys}, {sentences_sql('text')} as ss from {source}) where len(ss) > 0)"""


duck.register("packed", packed_sql("merged", "doc_id, k, title", 400), "merged")
duck.register("units", """
    select doc_id, k, title, j, array_to_string(ss[a:b], ' ') as text, list_sum(nn[a:b])::bigint as n, b - a + 1 as sentences
    from (select *, starts[j] as a, coalesce(starts[j + 1] - 1, len(ss)) as b
          from (select *, unnest(range(1, len(starts) + 1)) as j from packed))""", "packed")
_TOK = duck.tokens("text")
duck.register("pieces", f"""
    select doc_id, row_number() over (partition by doc_id order by k, j, w) as p, title, text from (
        select doc_id, k, j, 0 as w, title, text from numbered where n <= lim
        union all
        select doc_id, k, j, w, title, case when w = 0 then array_to_string(t[1:lim], '')
            else array_to_string(t[lim + (w - 1) * 432 + 1 : lim + w * 432], '') end
        from (select *, {_TOK} as t, unnest(range(0, 1 + ceil((n - lim) / 432.0)::bigint)) as w from numbered where n > lim))""",
    "numbered")
duck.CTES["numbered"] = """
    select *, case when row_number() over (partition by doc_id order by k, j) = 1 then 512 else 432 end as lim from units"""
duck.NEEDS["numbered"] = ("units",)
duck.register("streams", f"""
    select *, len(t) as n, coalesce(sum(len(t)) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from (select *, {duck.tokens("case when p = 1 then text else chr(10) || " + duck.strip('text') + " end")} as t from pieces)""", "pieces")
duck.register("drafts", f"""
    select s.doc_id, s.p, s.title, s.n + least(80, s.before) as token_count,
        {duck.strip("array_to_string(d.all_tokens[s.before - least(80, s.before) + 1 : s.before + s.n], '')")} as exact_context
    from streams s join (select doc_id, flatten(list(t order by p)) as all_tokens from streams group by doc_id) d using (doc_id)""",
    "streams")
duck.register("records", f"""
    select c.document_id || '::p0001::c' || printf('%04d', p) as chunk_id, c.document_id, c.source_org, c.source_url, c.document_title,
        left(c.publication_date, 4)::int as publication_year, 1 as page_number, p as chunk_index, x as exact_context,
        token_count, length(x) as char_count, 'unverified' as verification_status, sha256(x) as content_hash, d.doc_id
    from (select *, {duck.sanitize('exact_context')} as x from drafts) d join catalog c using (doc_id)
    where x <> '' and not {duck.is_placeholder('x')} and not {duck.is_explicit_noise('x')}""", "drafts", "catalog")


# --- queries --------------------------------------------------------------------------


@add("section_detect", duck.query(
    "select doc_id, k, title, start_char, end_char, sha256(text) as digest from sections", "sections"))
def section_detect(spark, sf):
    rows = chunking.with_sections(with_structure(spark, sf), merge=False)
    return exploded(rows, "sections", "k").select(
        "doc_id", "k", "x.title", F.col("x.start_char").cast("bigint").alias("start_char"),
        F.col("x.end_char").cast("bigint").alias("end_char"), F.sha2("x.text", 256).alias("digest"),
    )


@add("short_section_merge", duck.query(
    "select doc_id, k, title, start_char, end_char, sha256(text) as digest from merged", "merged"))
def short_section_merge(spark, sf):
    rows = chunking.with_sections(with_structure(spark, sf))
    return exploded(rows, "sections", "k").select(
        "doc_id", "k", "x.title", F.col("x.start_char").cast("bigint").alias("start_char"),
        F.col("x.end_char").cast("bigint").alias("end_char"), F.sha2("x.text", 256).alias("digest"),
    )


@add("unit_pack", duck.query(
    """select doc_id, row_number() over (partition by doc_id order by k, j) as u, title, n::bigint as n_tokens,
        sentences::bigint as n_sentences, sha256(text) as digest from units""", "units"))
def unit_pack(spark, sf):
    rows = chunking.with_units(chunking.with_sections(with_structure(spark, sf)))
    return exploded(rows, "units", "u").select(
        "doc_id", "u", F.col("x.section_title").alias("title"),
        F.col("x.token_count").cast("bigint").alias("n_tokens"),
        F.col("x.sentence_count").cast("bigint").alias("n_sentences"), F.sha2("x.text", 256).alias("digest"),
    )


_CAP = f"""capsource as (select doc_id, {duck.strip('text')} as text from documents),
    cappacked as ({packed_sql("(select * from capsource where " + duck.count_tokens('text') + " > 512)", "doc_id", 512)}),
    capgroups as (select doc_id, j, array_to_string(ss[a:b], ' ') as text, list_sum(nn[a:b])::bigint as n
        from (select *, starts[j] as a, coalesce(starts[j + 1] - 1, len(ss)) as b
              from (select *, unnest(range(1, len(starts) + 1)) as j from cappacked)))"""


@add("chunk_cap", duck.query(
    f"""select doc_id, row_number() over (partition by doc_id order by j, w) as piece, {duck.count_tokens('text')}::bigint as n_tokens, sha256(text) as digest from (
        select doc_id, 0 as j, 0 as w, text from capsource where {duck.count_tokens('text')} <= 512 and text <> ''
        union all select doc_id, j, 0, text from capgroups where n <= 512
        union all select doc_id, j, w, array_to_string(t[w * 512 + 1 : (w + 1) * 512], '')
            from (select *, {_TOK} as t, unnest(range(0, ceil(n / 512.0)::bigint)) as w from capgroups where n > 512))""",
    extra=_CAP))
def chunk_cap(spark, sf):
    from docloom.functions.text import count_tokens

    rows = tables.documents(spark, sf).select("doc_id", structure.cap_text(F.col("text")).alias("t"))
    return exploded(rows, "t", "piece").select(
        "doc_id", "piece", count_tokens(F.col("x")).cast("bigint").alias("n_tokens"),
        F.sha2("x", 256).alias("digest"),
    )


@add("token_windows", duck.query(
    f"""select doc_id, w, sha256(array_to_string(t[w * 128 + 1 : (w + 1) * 128], '')) as digest
        from (select doc_id, t, unnest(range(0, ceil(len(t) / 128.0)::bigint)) as w
              from (select doc_id, {duck.tokens(duck.strip('text'))} as t from documents))"""))
def token_windows(spark, sf):
    windows = structure.token_windows(strip(F.col("text")), 128)
    rows = exploded(tables.documents(spark, sf).select("doc_id", windows.alias("t")), "t", "w")
    return rows.select("doc_id", (F.col("w") - 1).alias("w"), F.sha2("x", 256).alias("digest"))


@add("chunk_overlap", duck.query(
    "select doc_id, p as seq, title, token_count::bigint as token_count, sha256(exact_context) as digest from drafts", "drafts"))
def chunk_overlap(spark, sf):
    drafted = chunking.with_drafts(
        chunking.with_units(chunking.with_sections(with_structure(spark, sf)))
    )
    return chunking.explode_drafts(drafted).select(
        "doc_id", (F.col("seq") + 1).cast("bigint").alias("seq"), F.col("section_title").alias("title"),
        F.col("token_count").cast("bigint").alias("token_count"), F.sha2("exact_context", 256).alias("digest"),
    )


def records(spark, sf):
    return chunking.chunk_records(with_structure(spark, sf), CREATED)


@add("chunk_records", duck.query(
    f"""select chunk_id, document_id, source_org, source_url, document_title, publication_year::bigint as publication_year,
        page_number::bigint as page_number, chunk_index::bigint as chunk_index, token_count::bigint as token_count,
        char_count::bigint as char_count, verification_status, content_hash, '{CREATED}' as created_at from records""", "records"))
def chunk_records(spark, sf):
    longs = ("publication_year", "page_number", "chunk_index", "token_count", "char_count")
    rows = records(spark, sf).drop("exact_context")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in longs})


@add("chunk_index", duck.query(
    """select document_id, 'data/chunks/' || replace(document_id, ':', '_') || '.jsonl' as chunk_file, count(*) as chunk_count,
        'sha256:' || left(sha256(string_agg(content_hash, chr(10) order by content_hash)), 16) as content_hash
       from records group by document_id""", "records"))
def chunk_index(spark, sf):
    return chunking.chunk_index(records(spark, sf))


@add("chunk_total", duck.query(
    "select count(distinct document_id) as documents, count(*) as total_chunks from records", "records"))
def chunk_total(spark, sf):
    return chunking.chunk_total(records(spark, sf))


@add("pii_drop_ratio", duck.query(
    f"""select document_id, sum(dirty::int)::bigint as dropped, count(*) as total, sum(dirty::int) / count(*) > 0.30 as review
        from (select document_id, len({duck.pii('exact_context')}) > 0 as dirty from records) group by document_id""", "records"))
def pii_drop_ratio(spark, sf):
    return chunking.pii_report(records(spark, sf))


@add("clean_chunks", duck.query(
    f"select chunk_id, content_hash from records where len({duck.pii('exact_context')}) = 0", "records"))
def clean_chunks(spark, sf):
    return chunking.drop_pii_chunks(records(spark, sf)).select("chunk_id", "content_hash")


_INCREMENTAL = """done as (select document_id, case when doc_id % 3 = 0 then ingested_at else '2026-06-05T00:00:00Z' end as source_ingested_at
    from catalog where doc_id % 2 = 0)"""


@add("incremental_skip", duck.query(
    """select c.document_id from catalog c left join done d using (document_id)
       where d.source_ingested_at is null or c.ingested_at::timestamptz > d.source_ingested_at::timestamptz""",
    "catalog", extra=_INCREMENTAL))
def incremental_skip(spark, sf):
    catalog = tables.catalog(spark, sf)
    done = catalog.filter(F.col("doc_id") % 2 == 0).select(
        "document_id",
        F.when(F.col("doc_id") % 3 == 0, F.col("ingested_at")).otherwise("2026-06-05T00:00:00Z").alias(
            "source_ingested_at"
        ),
    )
    return chunking.pending_documents(catalog, done).select("document_id")


@add("embed_batches", duck.query(
    """select doc_id, len(starts)::bigint as n_batches, array_to_string(starts, ' ') as starts from (
        select doc_id, list_transform(list_reduce(
            list_transform(nn, lambda n, i: {'n': n, 'i': i, 'c': case when n > 900 then 0 else 1 end,
                'sum': case when n > 900 then 0 else n end, 'starts': [i]}),
            lambda a, x: case when a.c = 0 or x.n > 900 or a.c >= 4 or a.sum + x.n > 900
                then {'n': x.n, 'i': x.i, 'c': x.c, 'sum': x.sum, 'starts': list_append(a.starts, x.i)}
                else {'n': x.n, 'i': x.i, 'c': a.c + 1, 'sum': a.sum + x.n, 'starts': a.starts} end).starts, lambda s: s - 1) as starts
        from (select doc_id, list_transform(string_split(text, chr(10)), lambda l: length(l)::bigint) as nn from documents))"""))
def embed_batches(spark, sf):
    lengths = F.transform(F.split("text", "\n"), lambda line: F.length(line))
    rows = tables.documents(spark, sf).select(
        "doc_id", structure.batch_starts(lengths, 4, 900).alias("starts")
    )
    return rows.select(
        "doc_id", F.size("starts").cast("bigint").alias("n_batches"),
        F.array_join(F.transform("starts", lambda s: s.cast("string")), " ").alias("starts"),
    )


# --- web pages ------------------------------------------------------------------------


@add("html_meta", duck.query(
    f"""select page_id, left(case when t <> '' then {duck.strip('t')} else url end, 280) as title,
        coalesce(nullif(regexp_extract(html, 'publicationDate=(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''),
          nullif(regexp_extract(html, '(?is)Published[^<]*<time datetime=["''](\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''),
          nullif(regexp_extract(html, '<time datetime="(\\d{{4}}-\\d{{2}}-\\d{{2}})"', 1), ''), '1970-01-01') as publication_date,
        regexp_extract(html, 'rel="canonical"\\s+href="([^"]+)"', 1) as canonical
       from (select *, regexp_extract(html, '(?i)<title>([^<]+)</title>', 1) as t from pages)"""))
def html_meta(spark, sf):
    rows = tables.spread(tables.table(spark, sf, "pages"))
    return rows.select(
        "page_id", html.page_title(F.col("html"), F.col("url")).alias("title"),
        html.page_date(F.col("html")).alias("publication_date"),
        html.canonical_url(F.col("html")).alias("canonical"),
    )


def _sections_sql():
    """The given pages cut by patterns: their furniture holds no element of its own kind."""
    text = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
    for tag in ("head", "title", *html.fv.STRIP_TAGS):
        text = f"regexp_replace({text}, '<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'gs')"
    blocks = "|".join(html.fv.BLOCK_TAGS)
    # 1 starts a page, 2 a block, 3 a piece
    for pattern, mark in (("<h[1-6]\\b[^>]*>", "chr(1) || chr(2)"), (f"</?({blocks})\\b[^>]*>", "chr(2)"), ("<[^>]*>", "chr(3)")):
        text = f"regexp_replace({text}, '{pattern}', {mark}, 'g')"
    for name, sign in (("&middot;", "chr(183)"), ("&copy;", "chr(169)"), ("&quot;", "chr(34)"), ("&amp;", "chr(38)")):
        text = f"replace({text}, '{name}', {sign})"
    pieces = f"list_filter(list_transform(string_split(b, chr(3)), lambda q: {duck.strip('q')}), lambda q: q <> '')"
    page = f"array_to_string(list_filter(list_transform(string_split(p, chr(2)), lambda b: array_to_string({pieces}, ' ')), lambda b: b <> ''), chr(10) || chr(10))"
    normal = f"regexp_replace(regexp_replace(nfc_normalize({page}), '[\\t \\x0b\\x0c\\p{{Zs}}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return duck.query(
        f"""select page_id, case when n is null then 'no text extracted' end as error, (n - 1 + first)::int as page_number,
            length(t)::int as n_chars, sha256(t) as digest
        from (select page_id from pages) left join (
            select page_id, n, t, max(case when n = 1 then 1 else 0 end) over (partition by page_id) as first
            from (select page_id, {normal} as t, n from (
                select page_id, unnest(s) as p, generate_subscripts(s, 1) as n from (select page_id, string_split({text}, chr(1)) as s from pages)))
            where t <> '') using (page_id)""")


@add("html_sections", _sections_sql())
def html_sections(spark, sf):
    rows = html.with_pages(tables.table(spark, sf, "pages"), "page_id")
    return rows.select("page_id", "error", F.explode_outer("pages").alias("p")).select(
        "page_id", "error", "p.page_number", F.length("p.text").alias("n_chars"),
        F.sha2("p.text", 256).alias("digest"),
    )


@add("html_chunks")
def html_chunks(spark, sf):
    from docloom.functions import identity

    rows = html.with_pages(tables.table(spark, sf, "pages"), "page_id")
    title = html.page_title(F.col("html"), F.col("url"))
    docs = rows.filter(F.col("error").isNull()).select(
        identity.document_id(F.col("url"), title).alias("document_id"),
        F.lit("Nature").alias("source_org"), F.col("url").alias("source_url"),
        title.alias("document_title"), html.page_date(F.col("html")).alias("publication_date"), "pages",
    )
    return chunking.chunk_records(docs, CREATED)
