"""Ranking, narrowing, routing and title resolution over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions import fixed_values as fv
from docloom.functions import text as tx
from docloom.operators import branches, impact_index, lexical, narrowing, resolve, vector, vector_cells
from docloom.session import materialize
from docloom.workload import duck, tables

QUERIES, ORACLES = {}, {}
QUESTION = "the retitioning onnerth edonre of ertion and inea ertion treatment"


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def corpus(spark, sf):
    return lexical.searchable(tables.document_chunks(spark, sf))


def rounded(hits, *keys):
    return hits.select(
        *keys, F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"),
        F.round("distance", 6).alias("distance"),
    )


# --- one question ---------------------------------------------------------------------

_TERMS = tx.lexical_tokens_py(QUESTION)


def bm25_sql(where: str, k: int) -> str:
    terms = ", ".join(f"({duck.lit(t)}, {_TERMS.count(t)})" for t in dict.fromkeys(_TERMS))
    return duck.query(
        f"""select chunk_id, rank, round(score, 6) as score, round(greatest(0.01, 1 / (1 + score)), 6) as distance
        from (select chunk_id, score, row_number() over (order by score desc, chunk_id) as rank from (
            select chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 9) as score
            from (select chunk_id, len(tokens) as dl, term, times, len(list_filter(tokens, lambda x: x = term)) as tf from scoped, q) h
            join dfs using (term, times) cross join stats group by chunk_id) where score > 0) where rank <= {k}""",
        "corpus",
        extra=f"""scoped as (select * from corpus where {where}), q(term, times) as (values {terms}),
            stats as (select count(*)::double as n, avg(len(tokens)) as avg_len from scoped),
            dfs as (select term, times, count(*) filter (where list_contains(tokens, term))::double as df from scoped, q group by term, times)""",
    )


@add("bm25_topk", bm25_sql("true", 20))
def bm25_topk(spark, sf):
    return rounded(lexical.search(corpus(spark, sf), QUESTION, 20), "chunk_id")


@add("bm25_scoped", bm25_sql("source = 'src1'", 8))
def bm25_scoped(spark, sf):
    """Statistics, too, are those of the scope."""
    scoped = corpus(spark, sf).filter(F.col("source") == "src1")
    return rounded(lexical.search(scoped, QUESTION, 8), "chunk_id")


@add("term_frequency", duck.query(
    "select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from corpus) group by all", "corpus"))
def term_frequency(spark, sf):
    return lexical.term_frequencies(corpus(spark, sf), "doc_id")


@add("term_df", duck.query(
    "select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from corpus) group by term", "corpus"))
def term_df(spark, sf):
    return lexical.document_frequencies(corpus(spark, sf))


@add("corpus_stats", duck.query(
    "select count(*) as n, sum(len(tokens))::bigint as total_len, round(avg(len(tokens)), 6) as avg_len from corpus", "corpus"))
def corpus_stats(spark, sf):
    return lexical.corpus_statistics(corpus(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))


# --- many questions -------------------------------------------------------------------

duck.register("source_corpus", """
    select * replace (source || '::p' || printf('%04d', doc_id) || '::c0001' as chunk_id, source as document_id) from corpus""", "corpus")
duck.register("qterms", f"""
    select qid, term, count(*) as times from (select qid, unnest({duck.words('question', 3, fv.LEXICAL_STOP)}) as term from questions)
    group by all""", "questions")


def many_sql(source: str, k: int, terms: str = "qterms") -> str:
    return f"""
    select * from (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from (
        select qid, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 9) as score
        from (select chunk_id, dl, term, count(*)::double as tf from (select chunk_id, len(tokens) as dl, unnest(tokens) as term from {source}) group by all) p
        join (select term, count(*)::double as df from (select unnest(list_distinct(tokens)) as term from {source}) group by term) f using (term)
        join {terms} using (term) cross join (select count(*)::double as n, avg(len(tokens)) as avg_len from {source})
        group by qid, chunk_id)) where rank <= {k}"""


duck.register("ranked", many_sql("source_corpus", 16), "source_corpus", "qterms")
duck.register("hits", """
    select r.qid, r.rank, greatest(0.01, 1 / (1 + r.score)) as distance, r.score, c.*
    from ranked r join source_corpus c using (chunk_id)""", "ranked")


def source_chunks(spark, sf):
    """Each given source is one document whose chunks are the given texts."""
    return tables.document_chunks(spark, sf).withColumns(
        {
            "chunk_id": F.format_string("%s::p%04d::c0001", F.col("source"), F.col("doc_id")),
            "document_id": F.col("source"),
        }
    )


def source_corpus(spark, sf):
    return lexical.searchable(source_chunks(spark, sf))


def hits(spark, sf, k=DEFAULT.fetch_k):
    """Hits with their chunks' titles."""
    chunks = lexical.prepared(source_corpus(spark, sf), ["chunk_id", "document_id", "document_title"])
    return lexical.attach(lexical.search_many(chunks, tables.questions(spark, sf), k), chunks.drop("terms", "times", "length"))


def top_texts(spark, sf, depth):
    """The first ``depth`` hits with their texts; only those texts are cleaned again."""
    chunks = lexical.prepared(source_corpus(spark, sf), ["chunk_id"])
    found = materialize(lexical.search_many(chunks, tables.questions(spark, sf), DEFAULT.fetch_k).filter(F.col("rank") <= depth))
    chosen = source_chunks(spark, sf).join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return lexical.attach(found, lexical.searchable(chosen).drop("tokens"))


def judged_chunks(spark, sf, *keep):
    """What the context limits ask of each chunk, without texts, and its terms."""
    return lexical.prepared(narrowing.context_facts(source_corpus(spark, sf), (*keep, "tokens")), ["chunk_id", *keep, "_document", "_usable"])


def judged_hits(spark, sf, chunks, k=DEFAULT.fetch_k):
    return lexical.attach(lexical.search_many(chunks, tables.questions(spark, sf), k), chunks.drop("terms", "times", "length"))


@add("bm25_batch", duck.query(
    """select qid, chunk_id, rank, round(score, 6) as score, round(greatest(0.01, 1 / (1 + score)), 6) as distance
       from ranked where rank <= 8""", "ranked"))
def bm25_batch(spark, sf):
    found = lexical.search_many(source_corpus(spark, sf), tables.questions(spark, sf), 8)
    return rounded(found, "qid", "chunk_id")


@add("bm25_batch_pruned", ORACLES["bm25_batch"])
def bm25_batch_pruned(spark, sf):
    """The same ranking from stored postings, entering documents by blocks that can still matter."""
    index = impact_index.build(source_corpus(spark, sf))
    return rounded(impact_index.search_many(index, tables.questions(spark, sf), 8), "qid", "chunk_id")


@add("bm25_batch_reading", duck.query(
    """select sum(n)::bigint as postings, true as pruned from (
        select qid, term from qterms) join (select term, count(*) as n from (select unnest(list_distinct(tokens)) as term from source_corpus) group by term) using (term)""",
    "source_corpus", "qterms"))
def bm25_batch_reading(spark, sf):
    """Postings of the questions' terms, and whether blocks left some of them unread."""
    index = impact_index.build(source_corpus(spark, sf))
    return impact_index.reading(index, tables.questions(spark, sf), 8).select("postings", (F.col("read") < F.col("postings")).alias("pruned"))


_SELECTED = f"""
    select *, row_number() over (partition by qid order by rank) as position from (
        select *, row_number() over (partition by qid, document_id order by rank) as n from hits
        where greatest(0, 1 - distance) >= MIN and not ({duck.low_title('document_title')} or length({duck.strip('exact_context')}) < 40))
    where n <= PER"""
duck.register("context", f"select * from ({_SELECTED.replace('MIN', '0.0').replace('PER', '1')}) where position <= 3", "hits")


@add("context_select", duck.query(
    f"""select qid, position, chunk_id from ({_SELECTED.replace('MIN', '0.18').replace('PER', '2')}) where position <= 5""", "hits"))
def context_select(spark, sf):
    chosen = narrowing.select_context(judged_hits(spark, sf, judged_chunks(spark, sf)), max_chunks=5, max_per_document=2)
    return chosen.select("qid", F.col("position").cast("bigint").alias("position"), "chunk_id")


@add("single_article", duck.query(
    """select qid, row_number() over (partition by qid order by rank) as position, chunk_id from (
        select *, first_value(document_id) over (partition by qid order by rank) as best from hits)
       where document_id = best qualify position <= 3""", "hits"))
def single_article(spark, sf):
    chosen = narrowing.single_article(hits(spark, sf))
    return chosen.select("qid", F.col("position").cast("bigint").alias("position"), "chunk_id")


@add("dedupe_one_per_doc", duck.query(
    """select qid, row_number() over (partition by qid order by rank) as position, chunk_id from (
        select *, row_number() over (partition by qid, document_id order by rank) as n from hits) where n = 1
       qualify position <= 6""", "hits"))
def dedupe_one_per_doc(spark, sf):
    chosen = narrowing.one_per_document(hits(spark, sf))
    return chosen.select("qid", F.col("position").cast("bigint").alias("position"), "chunk_id")


@add("distinct_docs_in_order", duck.query(
    "select qid, document_id, min(rank) as first_rank from hits where rank <= 6 group by all", "hits"))
def distinct_docs_in_order(spark, sf):
    return narrowing.distinct_documents(hits(spark, sf)).withColumn(
        "first_rank", F.col("first_rank").cast("bigint")
    )


@add("ambiguity_flag", duck.query(
    """select qid, round(best, 6) as best, round(rival, 6) as rival, coalesce(rival <= best * 1.15 + 0.08, false) as ambiguous from (
        select qid, arg_min(distance, rank) as best, arg_min(distance, rank) filter (where document_id <> best_doc) as rival
        from (select *, first_value(document_id) over (partition by qid order by rank) as best_doc from hits where rank <= 6) group by qid)""", "hits"))
def ambiguity_flag(spark, sf):
    return narrowing.ambiguity(hits(spark, sf)).withColumns(
        {"best": F.round("best", 6), "rival": F.round("rival", 6)}
    )


@add("retrieval_gate", duck.query(
    f"""select qid, 1 - distance >= 0.22 and distance <= 0.92 and
        (case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: contains(lower(exact_context), x)))::double / len(t) end) >= 0.08 as passes
        from (select h.*, list_distinct({duck.words('question', 4, fv.GATE_STOP)}) as t from hits h join questions using (qid) where rank = 1)""", "hits"))
def retrieval_gate(spark, sf):
    top = top_texts(spark, sf, 1)
    asked = tables.questions(spark, sf).select("qid", "question")
    return top.join(asked, "qid").select(
        "qid",
        narrowing.passes_gate(
            F.col("distance"), F.col("question"), F.col("exact_context"), F.lit("lexical")
        ).alias("passes"),
    )


@add("best_snippet", duck.query(
    f"""select qid, chunk_id, left(case when len(q) > 0 and coalesce(best.score, -1) > -1 then best.text else ex end, 160) as snippet from (
        select *, list_sort(list_transform(list_filter(ss, lambda x: {duck.strip('x')} <> ''), lambda x, i: {{'score': {duck.let(
            f"list_filter(regexp_extract_all(lower(x), '[a-z0-9_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{{4,}}$') and w not in {duck.inlist(fv.FRAGMENT_STOP)})",
            't', "case when len(t) = 0 then -1 else len(list_filter(t, lambda w: list_contains(q, w))) * 10 - case when length(x) < 40 or length(x) > 240 then 1 else 0 end end")},
            'rank': -i, 'text': x}}), 'DESC')[1] as best
        from (select qid, chunk_id, ex, q, string_split(regexp_replace(ex, '([.!?]) ', '\\1' || chr(2), 'g'), chr(2)) as ss from (
            select h.qid, h.chunk_id, {duck.collapse('exact_context')} as ex,
              list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{{4,}}$') and w not in {duck.inlist(fv.FRAGMENT_STOP)})) as q
            from hits h join questions using (qid) where rank <= 2)))""", "hits"))
def best_snippet(spark, sf):
    top = top_texts(spark, sf, 2)
    asked = tables.questions(spark, sf).select("qid", "question")
    return top.join(asked, "qid").select(
        "qid", "chunk_id", tx.best_snippet(F.col("exact_context"), F.col("question")).alias("snippet")
    )


@add("text_fragments")
def text_fragments(spark, sf):
    top = top_texts(spark, sf, 1)
    asked = tables.questions(spark, sf).select("qid", "question")
    return top.join(asked, "qid").select(
        "qid", "chunk_id", tx.text_fragment(F.col("exact_context"), F.col("question")).alias("fragment")
    )


# --- vectors --------------------------------------------------------------------------

_UNIT = "list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))))"
duck.register("units_v", f"select vec_id, label, {_UNIT} as v from embeddings")
duck.register("vdist", """
    select e.vec_id, e.label, round(1 - list_inner_product(e.v, q.v), 9) as distance
    from units_v e, (select v from units_v where vec_id = 0) q""", "units_v")


def embeddings(spark, sf):
    return tables.spread(tables.table(spark, sf, "embeddings"))


def query_vector(spark, sf):
    """The vector with id 0, as a scalar subquery."""
    one = vector.unit_vectors(tables.table(spark, sf, "embeddings").filter(F.col("vec_id") == 0))
    return one.select("embedding").scalar()


def shaped(rows):
    return rows.select(
        "vec_id", "label", F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
    )


def cosine_sql(inner: str, limit: float, outer: str = "true") -> str:
    return duck.query(
        f"""select vec_id, label, round(distance, 6) as distance, round(greatest(0, 1 - distance), 6) as similarity
        from (select * from vdist where {inner} order by distance, vec_id limit 10) where distance <= {limit} and {outer}""", "vdist")


@add("cosine_topk", cosine_sql("true", 2.0))
def cosine_topk(spark, sf):
    return shaped(vector.nearest(embeddings(spark, sf), query_vector(spark, sf), 10, key="vec_id", max_distance=2.0))


@add("cosine_threshold", cosine_sql("true", 0.78))
def cosine_threshold(spark, sf):
    return shaped(vector.nearest(embeddings(spark, sf), query_vector(spark, sf), 10, key="vec_id"))


@add("cosine_scoped_postfilter", cosine_sql("true", 2.0, "label % 2 = 0"))
def cosine_scoped_postfilter(spark, sf):
    return shaped(vector.nearest(
        embeddings(spark, sf), query_vector(spark, sf), 10, key="vec_id", max_distance=2.0,
        scope=F.col("label") % 2 == 0, scope_after=True,
    ))


@add("cosine_scoped", cosine_sql("label = 1", 2.0))
def cosine_scoped(spark, sf):
    return shaped(vector.nearest(
        embeddings(spark, sf), query_vector(spark, sf), 10, key="vec_id", max_distance=2.0,
        scope=F.col("label") == 1,
    ))


@add("cosine_batch", duck.query(
    """select qid, vec_id, rank, round(distance, 6) as distance from (
        select q.vec_id as qid, e.vec_id, round(1 - list_inner_product(e.v, q.v), 9) as distance,
          row_number() over (partition by q.vec_id order by round(1 - list_inner_product(e.v, q.v), 9), e.vec_id) as rank
        from units_v e, units_v q where q.vec_id % 20 = 0) where rank <= 5""", "units_v"))
def cosine_batch(spark, sf):
    """Every vector whose id is divisible by 20 as a query against the whole table."""
    queries = tables.table(spark, sf, "embeddings").filter(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").alias("qid"), "embedding"
    )
    found = vector.nearest_many(embeddings(spark, sf), queries, 5, key="vec_id")
    return found.select(
        "qid", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance")
    )


@add("cosine_index_topk", ORACLES["cosine_batch"])
def cosine_index_topk(spark, sf):
    """The same neighbours through the cells of a vector index."""
    queries = tables.table(spark, sf, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    index = vector_cells.build(embeddings(spark, sf), 64, key="vec_id")
    return vector_cells.nearest_many(index, queries, 5).select(
        "qid", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


@add("digest_vectors")
def digest_vectors(spark, sf):
    cfg = DEFAULT.with_(embedding_dimension=64)
    rows = vector.encode_chunks(tables.document_chunks(spark, sf), cfg=cfg)
    return rows.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# --- title resolution -----------------------------------------------------------------


duck.register("resolved", f"""
    select qid, case when best >= 0.48 and round(best - coalesce(second, 0), 9) >= 0.06 then document_id end as document_id,
        case when best >= 0.48 and round(best - coalesce(second, 0), 9) >= 0.06 then round(best, 6) end as score
        from (select qid, max(document_id) filter (where r = 1) as document_id, max(score) filter (where r = 1) as best, max(score) filter (where r = 2) as second
            from (select *, row_number() over (partition by qid order by score desc, document_id) as r from (
                select qid, document_id, round(case when p = d then least(1.0, s + 0.12) else s end, 9) as score from (
                    select q.qid, c.document_id, c.publication_date as p, q.d,
                        case when len(c.t) = 0 then 0.0 else len(list_intersect(c.t, q.t))::double / len(c.t) end as s
                    from (select qid, list_distinct({duck.words('question', 4, fv.TITLE_STOP)}) as t, regexp_extract(question, '\\d{{4}}-\\d{{2}}-\\d{{2}}') as d
                          from questions) q,
                         (select document_id, publication_date, list_distinct({duck.words('document_title', 4, fv.TITLE_STOP)}) as t from catalog where document_title <> '') c)))
            where r <= 2 group by qid)""", "questions", "catalog")


@add("doc_resolve_margin", duck.query("select * from resolved", "resolved"))
def doc_resolve_margin(spark, sf):
    found = resolve.resolve_documents(tables.questions(spark, sf).drop("document_id"), tables.catalog(spark, sf))
    return found.withColumn("score", F.round("score", 6))


# --- the first way that finds something -------------------------------------------------

# Closer than the library's own limits, so that some questions have no near passage.
_NEAR = DEFAULT.with_(max_distance=0.6, min_similarity=0.45)
duck.register("question_vectors", "select q.qid, case when q.conv_id % 2 = 1 then list_transform(v.v, lambda x: -x) else v.v end as v from questions q join units_v v on v.vec_id = q.conv_id", "questions", "units_v")
duck.register("chunk_vectors", "select c.chunk_id, c.document_id, v.v from source_corpus c join units_v v on v.vec_id = c.doc_id", "source_corpus", "units_v")


def _passages_sql(hits: str, floor: float, per: int = 1) -> str:
    return f"""
    select * from (select *, row_number() over (partition by qid order by rank) as position from (
        select *, row_number() over (partition by qid, document_id order by rank) as nth from {hits}
        where greatest(0, 1 - distance) >= {floor} and not ({duck.low_title('document_title')} or length({duck.strip('exact_context')}) < 40))
    where nth <= {per}) where position <= 3"""


duck.register("vector_hits", """
    select n.*, c.* exclude (chunk_id, document_id), c.document_id from (
        select qid, chunk_id, round(1 - list_inner_product(e.v, q.v), 9) as distance,
            row_number() over (partition by qid order by round(1 - list_inner_product(e.v, q.v), 9), chunk_id) as rank
        from chunk_vectors e, question_vectors q) n join source_corpus c using (chunk_id)
    where n.rank <= 16 and n.distance <= 0.6""", "question_vectors", "chunk_vectors", "source_corpus")
duck.register("vector_passages", _passages_sql("vector_hits", 0.45), "vector_hits")
duck.register("word_passages", _passages_sql("hits", 0.0), "hits")


def question_vectors(spark, sf):
    """Each question with the given vector of its conversation's number; odd ones point the other way, far from most."""
    own = F.when(F.col("vec_id") % 2 == 1, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    vectors = embeddings(spark, sf).select(F.col("vec_id").alias("conv_id"), own.alias("embedding"))
    return tables.questions(spark, sf).join(vectors, "conv_id").select("qid", "embedding")


def chunk_vectors(spark, sf, chunks):
    """Each chunk with the given vector of its text's number."""
    vectors = embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunks.select("chunk_id", "document_id", "doc_id").join(vectors, "doc_id").drop("doc_id")


@add("vector_route", duck.query(
    """select qid, 'vector' as mode, position, chunk_id from vector_passages
       union all select qid, 'lexical', position, chunk_id from word_passages where qid not in (select qid from vector_passages)""",
    "vector_passages", "word_passages"))
def vector_route(spark, sf):
    """Questions answered by vectors, and by words where no near passage is usable."""
    chunks = judged_chunks(spark, sf, "document_id", "doc_id")
    near = vector.nearest_many(chunk_vectors(spark, sf, chunks), question_vectors(spark, sf), 16)
    near = lexical.attach(near.filter(F.col("distance") <= _NEAR.max_distance), chunks.select("chunk_id", "_document", "_usable"))
    words = judged_hits(spark, sf, chunks, 16).select(*near.columns)
    found = branches.first_context([branches.Branch("vector", near, _NEAR.min_similarity), branches.Branch("lexical", words)], cfg=_NEAR)
    return found.select("qid", F.col("branch").alias("mode"), F.col("position").cast("bigint").alias("position"), "chunk_id")


duck.register("scoped_questions", """
    select q.qid, q.conv_id, d.source as document_id, case when q.conv_id % 3 = 0 then 'the of and' else q.question end as question
    from questions q join documents d on d.doc_id = q.conv_id""", "questions")
duck.register("scoped_hits", f"""
    select r.*, c.* exclude (chunk_id, document_id), c.document_id from (
        select qid, chunk_id, greatest(0.01, 1 / (1 + score)) as distance, row_number() over (partition by qid order by score desc, chunk_id) as rank from (
            select qid, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 9) as score
            from (select document_id, chunk_id, dl, term, count(*)::double as tf from (select document_id, chunk_id, len(tokens) as dl, unnest(tokens) as term from source_corpus) group by all) p
            join (select document_id, term, count(*)::double as df from (select document_id, unnest(list_distinct(tokens)) as term from source_corpus) group by all) using (document_id, term)
            join (select document_id, count(*)::double as n, avg(len(tokens)) as avg_len from source_corpus group by all) using (document_id)
            join (select qid, document_id, term, count(*) as times from (select qid, document_id, unnest({duck.words('question', 3, fv.LEXICAL_STOP)}) as term from scoped_questions) group by all) using (document_id, term)
            group by all)) r join source_corpus c using (chunk_id) where rank <= 16""", "scoped_questions", "source_corpus")
duck.register("scoped_near", """
    select n.*, c.* exclude (chunk_id, document_id), c.document_id from (
        select s.qid, e.chunk_id, round(1 - list_inner_product(e.v, q.v), 9) as distance,
            row_number() over (partition by s.qid order by round(1 - list_inner_product(e.v, q.v), 9), e.chunk_id) as rank
        from scoped_questions s join question_vectors q using (qid) join chunk_vectors e on e.document_id = s.document_id) n
    join source_corpus c using (chunk_id) where n.rank <= 16 and n.distance <= 0.78""", "scoped_questions", "question_vectors", "chunk_vectors", "source_corpus")
duck.register("document_hits", """
    select 'lexical' as branch, qid, chunk_id, distance, rank, document_id, document_title, exact_context from scoped_hits
    union all select 'vector', qid, chunk_id, distance, rank, document_id, document_title, exact_context from scoped_near where qid not in (select qid from scoped_hits)""",
    "scoped_hits", "scoped_near")


@add("document_route_fallback", duck.query(
    f"select qid, branch, position, chunk_id from ({_passages_sql('document_hits', 0.0, 3)})", "document_hits"))
def document_route_fallback(spark, sf):
    """Questions about one document, by its words or, where none match, by its vectors."""
    chunks = judged_chunks(spark, sf, "document_id", "doc_id")
    facts = chunks.select("chunk_id", "_document", "_usable")
    home = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("document_id"))
    asked = tables.questions(spark, sf).drop("document_id").join(home, "conv_id").withColumn(
        "question", F.when(F.col("conv_id") % 3 == 0, F.lit("the of and")).otherwise(F.col("question")))
    words = lexical.search_many(chunks, asked, 16, scope="document_id")
    inside = question_vectors(spark, sf).join(asked.select("qid", "document_id"), "qid")
    near = vector.nearest_in_scope(chunk_vectors(spark, sf, chunks), inside, "document_id", 16).filter(F.col("distance") <= DEFAULT.max_distance)
    ways = [branches.Branch(name, lexical.attach(rows.select("qid", "chunk_id", "rank", "distance"), facts)) for name, rows in (("lexical", words), ("vector", near))]
    first = branches.first_hits(ways).withColumnRenamed("branch", "way")
    found = branches.first_context([branches.Branch("document", first)], max_per_document=3)
    return found.select("qid", F.col("way").alias("branch"), F.col("position").cast("bigint").alias("position"), "chunk_id")
