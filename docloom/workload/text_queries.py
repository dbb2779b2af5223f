"""Queries over single rows: identity, text, quality, dates, links and question analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import dates, fixed_values as fv, identity, intent, quality, text, urls, vectors
from docloom.workload import duck, tables

QUERIES, ORACLES = {}, {}


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


@add("document_ids", duck.query(
    """select doc_id, document_id, document_id || '::p0001::c0003' as chunk_id,
        replace(document_id, ':', '_') as safe_name, sha256(text) as content_hash, local_path
       from (select c.*, f.text from catalog c join full_catalog f using (doc_id))""", "catalog"))
def document_ids(spark, sf):
    rows = tables.with_catalog_columns(tables.documents(spark, sf))
    return rows.select(
        "doc_id", "document_id",
        identity.chunk_id(F.col("document_id"), F.lit(1), F.lit(3)).alias("chunk_id"),
        identity.safe_name(F.col("document_id")).alias("safe_name"),
        identity.content_hash(F.col("text")).alias("content_hash"), "local_path",
    )


_PAGE_TEXT = "regexp_replace(html, '<[^>]*>', '  ' || chr(10), 'g')"


@add("normalize_text", duck.query(
    f"""select page_id, length(t) as n_chars, sha256(t) as digest from (
        select page_id, {duck.strip(
            "regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(raw), '\\r\\n?', chr(10), 'g'),"
            " '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[\\t \\x0b\\x0c\\p{Zs}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')")} as t
        from (select page_id, {_PAGE_TEXT} as raw from pages))"""))
def normalize_text(spark, sf):
    pages = tables.spread(tables.table(spark, sf, "pages"))
    raw = F.regexp_replace("html", "<[^>]*>", "  \n")
    out = text.normalize_page_text(raw)
    return pages.select("page_id", out.alias("t")).select(
        "page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("digest")
    )


@add("token_counts", duck.query(
    f"select doc_id, {duck.count_tokens('text')}::bigint as n_tokens, "
    f"array_to_string({duck.tokens(duck.strip('text'))}[-80:], '') as tail from documents"))
def token_counts(spark, sf):
    from docloom.functions.structure import overlap_tail

    return tables.documents(spark, sf).select(
        "doc_id", text.count_tokens(F.col("text")).cast("bigint").alias("n_tokens"),
        overlap_tail(text.strip(F.col("text"))).alias("tail"),
    )


_GUARD = "|".join(a[:-1].replace(".", r"\.") for a in fv.ABBREVIATIONS)
_MARK, _CUT = "chr(1)", "chr(2)"


def sentences_sql(x: str) -> str:
    guarded = (
        f"regexp_replace(p, {duck.lit(rf'(^|{duck.NOT_WORD})({_GUARD})[.]')}, '\\1\\2' || {_MARK}, 'g')"
    )
    cut = f"regexp_replace({guarded}, {duck.lit(rf'([.!?]){duck.SPACE}+')}, '\\1' || {_CUT}, 'g')"
    restored = f"list_transform(string_split({cut}, {_CUT}), lambda s: replace(s, {_MARK}, '.'))"
    paragraphs = f"regexp_split_to_array({duck.strip(x)}, {duck.lit(rf'\n{duck.SPACE}*\n')})"
    return (
        f"list_filter(flatten(list_transform({paragraphs}, lambda p0: "
        f"{duck.let(duck.strip('p0'), 'p', restored)})), lambda s: {duck.strip('s')} <> '')"
    )


@add("sentence_split", duck.query(
    f"""select doc_id, len(s)::bigint as n_sentences, sha256(array_to_string(s, '|')) as digest
        from (select doc_id, {sentences_sql("replace(text, '. The', ' etc. The')")} as s from documents)"""))
def sentence_split(spark, sf):
    body = F.replace(F.col("text"), F.lit(". The"), F.lit(" etc. The"))
    rows = tables.documents(spark, sf).withColumn("s", text.split_sentences(body))
    return rows.select(
        "doc_id", F.size("s").cast("bigint").alias("n_sentences"),
        F.sha2(F.array_join("s", "|"), 256).alias("digest"),
    )


# Real pages mix prose with page furniture; here each document gets some lines of it.
_FURNITURE_SQL = """(case doc_id % 5
    when 0 then 'Share this article' || chr(10) || text || chr(10) || 'Keywords: a, b' || chr(10) || '/s41467-026-73798-3'
    when 1 then 'Download PDF ' || text
    when 2 then 'Get shareable link now. ' || text || ' end.'
    when 3 then 'mock ingest content ' || text
    else text end)"""


def _furniture():
    d, t = F.col("doc_id") % 5, F.col("text")
    return (
        F.when(d == 0, F.concat(F.lit("Share this article\n"), t, F.lit("\nKeywords: a, b\n/s41467-026-73798-3")))
        .when(d == 1, F.concat(F.lit("Download PDF "), t))
        .when(d == 2, F.concat(F.lit("Get shareable link now. "), t, F.lit(" end.")))
        .when(d == 3, F.concat(F.lit("mock ingest content "), t))
        .otherwise(t)
    )


@add("sanitize_text", duck.query(
    f"""select doc_id, length(t)::bigint as n_chars, sha256(t) as digest from (
        select doc_id, {duck.sanitize('b')} as t from (select doc_id, {_FURNITURE_SQL} as b from documents))"""))
def sanitize_text(spark, sf):
    rows = tables.documents(spark, sf).select("doc_id", text.sanitize(_furniture()).alias("t"))
    return rows.select(
        "doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("digest")
    )


@add("noise_flags", duck.query(
    f"""select doc_id, {duck.is_placeholder('b')} as placeholder, {duck.is_explicit_noise('b')} as explicit_noise,
        {duck.is_boilerplate('b')} as boilerplate,
        not {duck.is_placeholder('b')} and not {duck.is_boilerplate('b')} as answerable
        from (select doc_id, {_FURNITURE_SQL} as b from documents)"""))
def noise_flags(spark, sf):
    rows = tables.documents(spark, sf).withColumn("b", _furniture())
    b = F.col("b")
    return rows.select(
        "doc_id", quality.is_placeholder(b).alias("placeholder"),
        quality.is_explicit_noise(b).alias("explicit_noise"),
        quality.is_boilerplate(b).alias("boilerplate"), quality.is_answerable(b).alias("answerable"),
    )


_ODD_TITLE_SQL = """case doc_id % 6 when 0 then '(1.2 MB)' when 1 then 'Guidelines' when 2 then ' '
    when 3 then null else document_title end"""


@add("title_repair", duck.query(
    f"""select doc_id, {duck.low_title('t')} as low_quality, {duck.resolve_title('t', 'source_url', 'text')} as title,
        {duck.low_title(duck.resolve_title('t', 'source_url', 'text'))} or length({duck.strip('text')}) < 40 as low_quality_chunk
        from (select *, {_ODD_TITLE_SQL} as t from full_catalog)""", "full_catalog"))
def title_repair(spark, sf):
    d = F.col("doc_id") % 6
    odd = (
        F.when(d == 0, F.lit("(1.2 MB)")).when(d == 1, F.lit("Guidelines")).when(d == 2, F.lit(" "))
        .when(d == 3, F.lit(None).cast("string")).otherwise(F.col("document_title"))
    )
    rows = tables.with_catalog_columns(tables.documents(spark, sf)).withColumn("t", odd)
    return rows.select(
        "doc_id", quality.is_low_quality_title(F.col("t")).alias("low_quality"),
        quality.resolve_title(F.col("t"), F.col("source_url"), F.col("text")).alias("title"),
        quality.is_low_quality_chunk(F.col("t"), F.col("source_url"), F.col("text")).alias(
            "low_quality_chunk"
        ),
    )


# Two personal-data classes occur in the given text; the others are written around row values.
_PII_SQL = """text || case doc_id % 7
    when 0 then ' 1234 5678 ' || lpad((doc_id % 10000)::varchar, 4, '0') || ' '
    when 1 then ' abcde' || lpad((doc_id % 10000)::varchar, 4, '0') || 'F.'
    when 2 then ' API_KEY = k' || doc_id
    when 3 then ' x' || doc_id || '@mail.org, ok'
    when 4 then ' +91 98765' || lpad((doc_id % 100000)::varchar, 5, '0')
    else '' end"""


def _with_pii():
    d = F.col("doc_id")
    four = F.lpad((d % 10000).cast("string"), 4, "0")
    return F.concat(
        F.col("text"),
        F.when(d % 7 == 0, F.concat(F.lit(" 1234 5678 "), four, F.lit(" ")))
        .when(d % 7 == 1, F.concat(F.lit(" abcde"), four, F.lit("F.")))
        .when(d % 7 == 2, F.concat(F.lit(" API_KEY = k"), d.cast("string")))
        .when(d % 7 == 3, F.concat(F.lit(" x"), d.cast("string"), F.lit("@mail.org, ok")))
        .when(d % 7 == 4, F.concat(F.lit(" +91 98765"), F.lpad((d % 100000).cast("string"), 5, "0")))
        .otherwise(F.lit("")),
    )


@add("pii_scan", duck.query(
    f"""select id, kind, len(v) = 0 as is_clean, array_to_string(v, ',') as violations from (
        select doc_id as id, 'document' as kind, {duck.pii('b')} as v from (select doc_id, {_PII_SQL} as b from documents)
        union all
        select conv_id * 1000 + turn, 'turn', {duck.pii('text')} from conversations)"""))
def pii_scan(spark, sf):
    docs = tables.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit("document").alias("kind"), _with_pii().alias("b")
    )
    turns = tables.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("turn").alias("kind"),
        F.col("text").alias("b"),
    )
    found = docs.unionByName(turns).withColumn("v", quality.pii_violations(F.col("b")))
    return found.select(
        "id", "kind", (F.size("v") == 0).alias("is_clean"), F.array_join("v", ",").alias("violations")
    )


@add("date_parse", duck.query(
    r"""select qid, strftime(d, '%Y-%m-%d') as asked, strftime(p, '%Y-%m-%d') as published from (
        select qid, case
            when regexp_matches(q, '\d{4}-\d{2}-\d{2}') then try_cast(regexp_extract(q, '\d{4}-\d{2}-\d{2}') as date)
            when regexp_matches(q, '\d{1,2}\s+june\s+\d{4}') then
                try_cast(regexp_extract(q, '(\d{1,2})\s+june\s+(\d{4})', 2) || '-06-' || lpad(regexp_extract(q, '(\d{1,2})\s+june\s+(\d{4})', 1), 2, '0') as date)
            when regexp_matches(q, 'june\s+\d{1,2},?\s+\d{4}') then
                try_cast(regexp_extract(q, 'june\s+(\d{1,2}),?\s+(\d{4})', 2) || '-06-' || lpad(regexp_extract(q, 'june\s+(\d{1,2}),?\s+(\d{4})', 1), 2, '0') as date)
            end as d,
            coalesce(try_cast(nullif(regexp_extract(q, '\d{4}-\d{2}-\d{2}'), '') as date),
                try_cast(regexp_extract(q, '(\d{1,2})\s+june\s+(\d{4})', 2) || '-06-' || lpad(regexp_extract(q, '(\d{1,2})\s+june\s+(\d{4})', 1), 2, '0') as date)) as p
        from (select doc_id as qid, lower(case doc_id % 4
            when 0 then 'reports on ' || publication_date
            when 1 then 'articles of ' || (doc_id % 35) || ' June 2026'
            when 2 then 'Published June ' || (doc_id % 35) || ', 2026 by us'
            else document_title end) as q from catalog))""", "catalog"))
def date_parse(spark, sf):
    d = F.col("doc_id")
    day = (d % 35).cast("string")
    q = (
        F.when(d % 4 == 0, F.concat(F.lit("reports on "), F.col("publication_date")))
        .when(d % 4 == 1, F.concat(F.lit("articles of "), day, F.lit(" June 2026")))
        .when(d % 4 == 2, F.concat(F.lit("Published June "), day, F.lit(", 2026 by us")))
        .otherwise(F.col("document_title"))
    )
    return tables.catalog(spark, sf).select(d.alias("qid"), q.alias("q")).select(
        "qid", F.date_format(dates.question_date(F.col("q")), "yyyy-MM-dd").alias("asked"),
        F.date_format(dates.stated_publication_date(F.col("q")), "yyyy-MM-dd").alias("published"),
    )


def intent_sql(q: str) -> str:
    w = duck.has_word
    return f"""
        select *, case
              when {w('q', fv.COUNT_ALTERNATIVES)} or ({w('q', fv.HOW_MUCH_ALTERNATIVES)} and {w('q', fv.HOW_MUCH_SUBJECTS)}) then 'count'
              when {w('q', fv.LIST_ALTERNATIVES)} or (report_like and target_date is not null) then 'list'
              when {w('q', fv.EXPLAIN_ALTERNATIVES)} then 'explain' else 'general' end as intent
        from (select *, {w('q', fv.REPORT_ALTERNATIVES)} as report_like,
            case when {w('q', 'nature')} then 'Nature' when {w('q', 'icmr')} then 'ICMR' when {w('q', 'dhr|htain')} then 'DHR' end as source_org,
            try_cast(nullif(regexp_extract(q, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') as date) as target_date
            from (select *, lower({q}) as q from questions))"""


duck.register("intents", intent_sql("question"), "questions")
_W = duck.has_word
_TRIVIA = f"({_W('q', fv.FOOD_ALTERNATIVES)} and not {_W('q', fv.CORPUS_META_ALTERNATIVES)})"
duck.register("enumerated", """
    select *, intent in ('count', 'list') or (report_like and (source_org is not null or target_date is not null)) as enumeration
    from intents""", "intents")
duck.register("multi", f"""
    select *, enumeration and not {_TRIVIA} and ({_W('q', fv.CORPUS_META_ALTERNATIVES)} or {_W('q', fv.ENUMERATION_ALTERNATIVES)}) as multi_article
    from enumerated""", "enumerated")
duck.register("analyzed", f"""
    select *, case when {duck.strip('q')} = '' or {_W('q', fv.NON_MEDICAL_ALTERNATIVES)} or {_TRIVIA} then false
        when multi_article then true
        when {_W('q', fv.CORPUS_META_ALTERNATIVES)} and {_W('q', fv.META_COUNT_ALTERNATIVES)} then true
        when {_W('q', fv.MEDICAL_DOMAIN_ALTERNATIVES)} then true
        else list_has_any({duck.words('q', 4, fv.GATE_STOP)}, {duck.lits(fv.MEDICAL_TERMS)}) end as in_scope
    from multi""", "multi")


@add("query_intent", duck.query(
    """select qid, intent, source_org, strftime(target_date, '%Y-%m-%d') as target_date, enumeration, multi_article, in_scope
       from analyzed""", "analyzed"))
def query_intent(spark, sf):
    return intent.analyze(tables.questions(spark, sf)).select(
        "qid", "intent", "source_org", F.date_format("target_date", "yyyy-MM-dd").alias("target_date"),
        "enumeration", "multi_article", "in_scope",
    )


TOPIC_SQL = (
    "list_distinct(list_filter(regexp_extract_all(regexp_replace(q, '\\d{4}-\\d{2}-\\d{2}', ' ', 'g'), '[a-z][a-z0-9]{3,}'), "
    f"lambda t: t not in {duck.inlist(fv.LIST_TOPIC_STOP)} and t <> coalesce(lower(source_org), '')))"
)


@add("topic_filter", duck.query(
    f"""select qid, array_to_string(list_sort(terms), ' ') as terms,
        len(terms) = 0 or len(list_filter(terms, lambda t: contains(lower(a.document_title || ' ' || a.text), t))) > 0 as matches
        from (select qid, document_id, {TOPIC_SQL} as terms from analyzed) q join full_catalog a using (document_id)""",
    "analyzed"))
def topic_filter(spark, sf):
    q = intent.analyze(tables.questions(spark, sf)).select(
        "qid", "document_id", intent.topic_terms(F.col("question"), F.col("source_org")).alias("t")
    )
    docs = tables.with_catalog_columns(tables.documents(spark, sf)).select(
        "document_id", "document_title", "text"
    )
    return q.join(docs, "document_id").select(
        "qid", F.array_join(F.array_sort("t"), " ").alias("terms"),
        intent.matches_topic(F.col("t"), F.col("document_title"), F.col("text")).alias("matches"),
    )


@add("overlap_gate", duck.query(
    f"""select qid, round(case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: contains(lower(text), x)))::double / len(t) end, 6) as share
        from (select qid, document_id, list_distinct({duck.words('question', 4, fv.GATE_STOP)}) as t from questions)
        join full_catalog using (document_id)""", "questions"))
def overlap_gate(spark, sf):
    docs = tables.with_catalog_columns(tables.documents(spark, sf)).select("document_id", "text")
    return tables.questions(spark, sf).join(docs, "document_id").select(
        "qid",
        F.round(text.overlap_share(text.gate_terms(F.col("question")), F.col("text")), 6).alias("share"),
    )


@add("follow_up_test", duck.query(
    f"""select qid, len(a) > 0 and len(b) > 0 and (len(list_intersect(a, b)) >= 2
          or (length(p) > 12 and contains(lower({duck.strip('question')}), p))) as follow_up
        from (select qid, question, left(lower({duck.strip('anchor')}), 48) as p,
            list_distinct(list_filter(regexp_extract_all(lower(question), '\\b[a-z0-9]{{4,}}\\b'), lambda w: w not in {duck.inlist(fv.FOLLOW_UP_STOP)})) as a,
            list_distinct(list_filter(regexp_extract_all(lower(anchor), '\\b[a-z0-9]{{4,}}\\b'), lambda w: w not in {duck.inlist(fv.FOLLOW_UP_STOP)})) as b
        from (select q.qid, q.question, c.document_title as anchor from questions q join full_catalog c using (document_id)))""",
    "questions"))
def follow_up_test(spark, sf):
    titles = tables.catalog(spark, sf).select("document_id", F.col("document_title").alias("anchor"))
    return tables.questions(spark, sf).join(titles, "document_id").select(
        "qid", text.is_follow_up(F.col("question"), F.col("anchor")).alias("follow_up")
    )


@add("url_policy", duck.query(
    """select page_id, case when coalesce(regexp_extract(listing, '[?&]date_range=([^&#]*)', 1), '') <> 'last_30_days' then 'date_range'
          when coalesce(regexp_extract(listing, '[?&]subject=([^&#]*)', 1), '') <> 'medical-research' then 'subject'
          when coalesce(regexp_extract(listing, '[?&]article_type=([^&#]*)', 1), '') <> 'research' then 'article_type' end as violation,
        case when page_id % 3 + 1 > 1 then listing || '&page=' || (page_id % 3 + 1) else listing end as page_url
       from (select page_id, split_part(split_part(url, '#', 1), '?', 1) || case page_id % 4
            when 0 then '?article_type=research&subject=medical-research&date_range=last_30_days'
            when 1 then '?subject=medical-research&date_range=last_30_days'
            when 2 then '?article_type=research&subject=other&date_range=last_30_days'
            else '?q=1' end as listing from pages)"""))
def url_policy(spark, sf):
    p = F.col("page_id")
    query = (
        F.when(p % 4 == 0, "?article_type=research&subject=medical-research&date_range=last_30_days")
        .when(p % 4 == 1, "?subject=medical-research&date_range=last_30_days")
        .when(p % 4 == 2, "?article_type=research&subject=other&date_range=last_30_days")
        .otherwise("?q=1")
    )
    base = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    rows = tables.table(spark, sf, "pages").select("page_id", F.concat(base, query).alias("listing"))
    return rows.select(
        "page_id", urls.policy_violation(F.col("listing")).alias("violation"),
        urls.page_url(F.col("listing"), p % 3 + 1).alias("page_url"),
    )


@add("content_types", duck.query(
    r"""select id, case when ends_with(lower(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '.pdf') then 'pdf' else 'html' end as content_type,
        regexp_matches(u, '(?i)nature\.com/articles/s\d+') as article, contains(lower(u), 'nature.com/articles') as portfolio
       from (select doc_id as id, source_url as u from catalog union all select -1 - page_id, url from pages)""", "catalog"))
def content_types(spark, sf):
    docs = tables.catalog(spark, sf).select(F.col("doc_id").alias("id"), F.col("source_url").alias("u"))
    pages = tables.table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("u"))
    return docs.unionByName(pages).select(
        "id", urls.content_type(F.col("u")).alias("content_type"),
        urls.is_article_url(F.col("u")).alias("article"),
        quality.in_portfolio(F.col("u")).alias("portfolio"),
    )


@add("l2_normalize_check", duck.query(
    """select vec_id, round(n, 6) as norm, abs(n - 1) < 1e-5 as was_unit,
          round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) as norm_after, round(e[1] / n, 6) as first_value
       from (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n
             from (select vec_id, embedding::double[] as e from embeddings))"""))
def l2_normalize_check(spark, sf):
    rows = tables.spread(tables.table(spark, sf, "embeddings"))
    v = F.col("embedding")
    return rows.select(
        "vec_id", F.round(vectors.l2_norm(v), 6).alias("norm"), vectors.is_unit(v).alias("was_unit"),
        vectors.l2_normalize(v).alias("u"),
    ).select(
        "vec_id", "norm", "was_unit", F.round(vectors.l2_norm(F.col("u")), 6).alias("norm_after"),
        F.round(F.get("u", F.lit(0)), 6).alias("first_value"),
    )
