"""Search and ranking quality over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluate, search
from corvane.session import read

#: A fixed set of query texts in the languages of the corpus.
TEXTS = ("search index", "harbour office weather", "vieux phare canal", "Wasserturm Regen", "biblioteca horario", "vuurtoren haven", "retry queue on a slow network", "mountain hut budget")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS, 1)], "query_id bigint, query string")


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """The stated set, which grows with the table: titles of every fiftieth document."""
    return read(spark, d, "documents").where("doc_id % 50 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _best(docs: DataFrame, asked: DataFrame, ask: Callable, k: int) -> DataFrame:
    """The k best of each query; scores of the stated set are rounded first, so copies tie whatever the order of their sums."""
    return search.top_k(search.bm25(docs, asked), k) if ask is _queries else search.bm25_of_many(docs, asked, k, digits=9)


def flagship_bm25_topk(spark: SparkSession, d: str, ask: Callable = _queries) -> DataFrame:
    """The ten best documents of each query with their title and snippet (a top-k report)."""
    docs = read(spark, d, "documents")
    top = _best(docs, ask(spark, d), ask, 10)
    shown = docs.select("doc_id", "source", F.substring("text", 1, 400).alias("snippet"))
    return top.join(shown, "doc_id").select("query_id", "rank", "doc_id", "source", F.round("score", 6).alias("score"), "snippet")


def bm25_scores(spark: SparkSession, d: str, ask: Callable = _queries) -> DataFrame:
    """Scores of all documents that match a query."""
    docs, asked = read(spark, d, "documents"), ask(spark, d)
    if ask is _queries:
        return search.bm25(docs, asked).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    # round() goes through decimals, which is too slow for every pair
    return search.bm25_of_many(docs, asked, digits=9).select("query_id", "doc_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


def bm25_filtered(spark: SparkSession, d: str, ask: Callable = _queries) -> DataFrame:
    docs = read(spark, d, "documents").where(search.payload_filter("news", published_from="2021-01-01", published_to="2023-12-31 00:00:00"))
    return _best(docs, ask(spark, d), ask, 10).select("query_id", "rank", "doc_id")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, d, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return search.dense_top_k(v, q, 10).select("query_id", "rank", "doc_id", F.round("score", 5).alias("score"))


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return search.dense_top_k(v, q, 10, where=F.col("label") < 5).select("query_id", "rank", "doc_id")


def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten best that the cluster index finds for the stated queries, with its defaults."""
    v, q = _vectors(spark, d)
    exact = search.dense_top_k(v, q, 10).select("query_id", "doc_id")
    got = search.ClusterIndex.build(v).search(q, 10).select("query_id", "doc_id")
    return exact.join(got.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").agg(F.count("*").alias("wanted"), (F.count("hit") / F.count("*")).alias("recall"))


def hybrid_rrf(spark: SparkSession, d: str, ask: Callable = _queries) -> DataFrame:
    """Lexical leg by the query, dense leg by a vector of the same number."""
    docs, (v, asked) = read(spark, d, "documents"), _vectors(spark, d)
    if ask is _queries:
        asked = v.where(f"vec_id BETWEEN 1 AND {len(TEXTS)}").select(F.col("vec_id").alias("query_id"), "embedding")
    legs = [_best(docs, ask(spark, d), ask, 40), search.dense_top_k(v, asked, 40)]
    return search.reciprocal_rank_fusion(legs, 10).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def fan_out(spark: SparkSession, d: str, ask: Callable = _queries) -> DataFrame:
    docs = read(spark, d, "documents")
    sources = read(spark, d, "sources").select("source", (F.col("family") != "hn").alias("enabled"), (F.col("family") != "memory").alias("include_in_all"))
    if ask is _queries:
        scores = search.bm25(docs, ask(spark, d)).join(docs.select("doc_id", "source"), "doc_id")
    else:
        scores = search.bm25_of_many(docs, ask(spark, d), 3, by="source", digits=9).drop("rank")
    return search.fan_out(scores, sources, 3, 10).select("query_id", "rank", "doc_id", "source")


def rerank_overlap(spark: SparkSession, d: str, ask: Callable = _queries) -> DataFrame:
    docs, asked = read(spark, d, "documents").select("doc_id", F.substring("text", 1, 400).alias("body")), ask(spark, d)
    found = _best(read(spark, d, "documents"), asked, ask, 50).join(docs, "doc_id").join(asked, "query_id")
    return search.rerank(found, search.overlap_scorer, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def get_document(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    first = docs.agg(F.min("id").alias("id")).first()["id"]
    return search.get_document(docs.select("id", "source", "url"), docs.select("id", "text"), first)


# --- evaluation: a document's label is the label of its vector ---------------------------------------------------------
def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, q = _vectors(spark, d)
    ranked = search.dense_top_k(v, q, 20).select("query_id", "doc_id", "rank")
    labels = v.select(F.col("vec_id").alias("doc_id"), "label")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    judged = asked.join(labels, "label").select("query_id", "doc_id", F.when(F.col("query_id") == F.col("doc_id"), 3).otherwise(1).alias("grade"))
    return asked.select("query_id"), ranked, judged


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.metrics(*_ranked(spark, d), 10)
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall", "precision", "hit")])


def mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.means(evaluate.metrics(*_ranked(spark, d), 10))


def known_item(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every fiftieth document as queries that should find it, by source."""
    docs = read(spark, d, "documents")
    asked = docs.where("doc_id % 50 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"), "source")
    ranked = search.bm25_of_many(docs, asked, 10).select("query_id", "doc_id", "rank")
    judged = asked.select("query_id", F.col("query_id").alias("doc_id"), F.lit(1).alias("grade"))
    return evaluate.means(evaluate.metrics(asked, ranked, judged, 10).join(asked.select("query_id", "source"), "query_id"), ("source",), ("mrr", "hit"))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the hundred rows with the least md5."""
    return evaluate.seeded_order(read(spark, d, "documents").select("doc_id"), "doc_id", "42", 100)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    weights = {"news_tidewater": 3.0, "wiki_lumen": 1.0, "hf_cards": 0.01}
    return evaluate.stratified(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", weights, 40, "s")


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    _, ranked, judged = _ranked(spark, d)
    return evaluate.hard_negatives(ranked, judged, 3).select("query_id", "doc_id", "place")


def guardrail(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "events").select((F.col("user_id")).alias("query_id"), F.col("event_id").alias("doc_id"), F.when(F.col("event_type") == "error", "junk").when(F.col("event_type") == "purchase", "positive").otherwise("negative").alias("kind"), F.col("value").alias("score"))
    return evaluate.guardrail(v, 100.0)


QUERIES = {f.__name__: f for f in (
    flagship_bm25_topk, bm25_scores, bm25_filtered, dense_topk, dense_filtered, index_recall, hybrid_rrf, fan_out, rerank_overlap, get_document,
    rank_metrics, mean_metrics, known_item, seeded_sample, stratified_sample, hard_negatives, guardrail,
)}

#: Parameters that every profile is asked with; each uses those it knows.
ASKED_FOR = {"published_from": "2021-01-01", "published_to": "2023-12-31 00:00:00", "language": "en", "min_stars": 300, "min_points": 250, "outlet": "smallweb_fernlog",
    "framework": "docs_quarry", "root": "hf_cards", "kind": "hf", "conversation_id": "memory_notes", "primary_category": "arxiv_mirror"}


def profile_filter(spark: SparkSession, d: str, profile: str) -> DataFrame:
    """Documents that a search of a profile is restricted to; the fields of the payload are made of the document's own."""
    source = F.col("source")
    docs = read(spark, d, "documents").select(
        "doc_id", "published_at", F.col("lang").alias("language"), (F.col("doc_id") % 1000).alias("stars"), (F.col("n_chars") % 500).alias("points"),
        *[source.alias(c) for c in ("outlet", "framework", "root", "conversation_id", "primary_category")], F.split_part(source, F.lit("_"), F.lit(1)).alias("kind"),
    )
    return docs.where(search.payload_filter(profile, **ASKED_FOR)).select("doc_id")


QUERIES |= {f"filter_{name}": partial(profile_filter, profile=name) for name in (*search.PROFILES, "unnamed")}

STATED = ("bm25_scores", "bm25_filtered", "hybrid_rrf", "fan_out", "rerank_overlap")
QUERIES |= {"bm25_topk_stated": partial(flagship_bm25_topk, ask=_stated)} | {f"{name}_stated": partial(QUERIES[name], ask=_stated) for name in STATED}

WORDS = r"list_filter(string_split(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"


def bm25_sql(queries: str, docs: str = "documents") -> str:
    return f"""
    asked AS ({queries}),
    terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({WORDS.format(c='query')}) AS term FROM asked) GROUP BY 1, 2),
    sized AS (SELECT doc_id, {WORDS.format(c='text')} AS w FROM {docs} WHERE text IS NOT NULL), lens AS (SELECT doc_id, w, len(w) AS dl FROM sized),
    total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    posts AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM lens) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3),
    dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
    scores AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM posts JOIN terms USING (term) JOIN dfs USING (term), total GROUP BY 1, 2)"""


ASKED = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), '{t}')" for k, t in enumerate(TEXTS, 1)) + ") AS q(query_id, query)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"
DENSE = lambda where="true": f"""
    d AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE {where}), q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, doc_id, list_dot_product(d.e, q.e) / sqrt(list_dot_product(d.e, d.e)) / sqrt(list_dot_product(q.e, q.e)) AS score FROM d, q)"""  # noqa: E731
EVAL = f"""{DENSE()},
    ranked AS (SELECT query_id, doc_id, {RANK} AS rank FROM s QUALIFY rank <= 20),
    judged AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CASE WHEN a.vec_id = b.vec_id THEN 3 ELSE 1 END AS grade FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0),
    found AS (SELECT query_id, sum(coalesce(grade, 0) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, min(rank) FILTER (grade > 0) AS first, count(*) FILTER (grade > 0 AND rank <= 10) AS hits FROM ranked LEFT JOIN judged USING (query_id, doc_id) GROUP BY 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM judged),
    ideal AS (SELECT query_id, sum(grade / log2(place + 1)) FILTER (place <= 10) AS idcg, count(*) AS relevant FROM placed GROUP BY 1),
    m AS (SELECT query_id, dcg / idcg AS ndcg, coalesce(1.0 / first, 0) AS mrr, hits / relevant AS recall, hits / 10 AS precision, CAST(hits > 0 AS DOUBLE) AS hit FROM found JOIN ideal USING (query_id))"""

SQL = {
    "flagship_bm25_topk": f"""WITH {bm25_sql(ASKED)}, r AS (SELECT query_id, doc_id, score, {RANK} AS rank FROM scores QUALIFY rank <= 10)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, source, round(score, 6) AS score, substr(text, 1, 400) AS snippet FROM r JOIN documents USING (doc_id)""",
    "bm25_scores": f"WITH {bm25_sql(ASKED)} SELECT query_id, doc_id, round(score, 6) AS score FROM scores",
    "bm25_filtered": f"""WITH kept AS (SELECT * FROM documents WHERE published_at BETWEEN TIMESTAMPTZ '2021-01-01 00:00:00+00' AND TIMESTAMPTZ '2023-12-31 00:00:00+00'), {bm25_sql(ASKED, 'kept')}
        SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id FROM scores QUALIFY rank <= 10""",
    "dense_topk": f"WITH {DENSE()} SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id, round(score, 5) AS score FROM s QUALIFY rank <= 10",
    "dense_filtered": f"WITH {DENSE('label < 5')} SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id FROM s QUALIFY rank <= 10",
    "hybrid_rrf": f"""WITH {bm25_sql(ASKED)}, d AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT doc_id AS query_id, e FROM d WHERE doc_id BETWEEN 1 AND {len(TEXTS)}),
        s AS (SELECT query_id, doc_id, list_dot_product(d.e, q.e) / sqrt(list_dot_product(d.e, d.e)) / sqrt(list_dot_product(q.e, q.e)) AS score FROM d, q),
        legs AS (SELECT query_id, doc_id, {RANK} AS r FROM scores QUALIFY r <= 40 UNION ALL SELECT query_id, doc_id, {RANK} AS r FROM s QUALIFY r <= 40), f AS (SELECT query_id, doc_id, sum(1.0 / (60 + r)) AS score FROM legs GROUP BY 1, 2)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 9) AS score FROM f QUALIFY rank <= 10""",
    "fan_out": f"""WITH {bm25_sql(ASKED)}, j AS (SELECT s.*, source FROM scores s JOIN documents USING (doc_id) WHERE source IN (SELECT source FROM sources WHERE family NOT IN ('hn', 'memory'))),
        b AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS p FROM j QUALIFY p <= 3) SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id, source FROM b QUALIFY rank <= 10""",
    "rerank_overlap": f"""WITH {bm25_sql(ASKED)}, t AS (SELECT query_id, doc_id, {RANK} AS r FROM scores QUALIFY r <= 50),
        o AS (SELECT query_id, doc_id, len(list_intersect(list_distinct({WORDS.format(c='query')}), {WORDS.format(c='substr(text, 1, 400)')})) / len(list_distinct({WORDS.format(c='query')})) AS score FROM t JOIN asked USING (query_id) JOIN documents USING (doc_id))
        SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM o QUALIFY rank <= 10""",
    "get_document": "SELECT id, source, url, text FROM documents WHERE id = (SELECT min(id) FROM documents)",
    "rank_metrics": f"WITH {EVAL} SELECT query_id, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hit, 6) AS hit FROM m",
    "mean_metrics": f"WITH {EVAL} SELECT round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(hit), 6) AS hit, count(*) AS queries FROM m",
    "known_item": f"""WITH {bm25_sql("SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL")}, t AS (SELECT query_id, doc_id, {RANK} AS r FROM scores QUALIFY r <= 10)
        SELECT source, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit, count(*) AS queries FROM documents d LEFT JOIN t ON t.query_id = d.doc_id AND t.doc_id = d.doc_id WHERE d.doc_id % 50 = 0 AND title IS NOT NULL GROUP BY 1""",
    "seeded_sample": "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 100",
    "stratified_sample": "SELECT doc_id, source FROM documents WHERE source IN ('news_tidewater', 'wiki_lumen', 'hf_cards') QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || 's'), doc_id) <= CASE source WHEN 'news_tidewater' THEN 30 WHEN 'wiki_lumen' THEN 10 ELSE 1 END",
    "hard_negatives": f"WITH {EVAL}, w AS (SELECT r.* FROM ranked r ANTI JOIN judged USING (query_id, doc_id)) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS INTEGER) AS place FROM w QUALIFY place <= 3",
    "guardrail": """
        WITH v AS (SELECT user_id AS q, event_id, CASE event_type WHEN 'error' THEN 'junk' WHEN 'purchase' THEN 'positive' ELSE 'negative' END AS kind, value FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY value DESC, event_id) AS rank FROM v), p AS (SELECT q, min(rank) FILTER (kind = 'positive') AS first FROM r GROUP BY 1), e AS (SELECT max(value) FILTER (kind = 'junk') AS junk_max, min(value) FILTER (kind = 'positive') AS pos_min FROM v)
        SELECT junk_max, pos_min, (SELECT round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) FROM p) AS top1, (SELECT round(avg(coalesce(1.0 / first, 0)), 6) FROM p) AS mrr, junk_max < 100 AND pos_min > junk_max AS passed FROM e""",
}


#: The same over the stated set, with scores rounded before they are ranked.
STATED_SQL = "SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL"


def _stated_sql(sql: str) -> str:
    sql = sql.replace(ASKED, STATED_SQL).replace(f"doc_id BETWEEN 1 AND {len(TEXTS)}", "doc_id % 50 = 0")
    return sql.replace("scores AS (SELECT query_id, doc_id, sum(", "scores AS (SELECT query_id, doc_id, round(sum(").replace("dl / avgdl))) AS score", "dl / avgdl))), 9) AS score")


SQL |= {"bm25_topk_stated": _stated_sql(SQL["flagship_bm25_topk"])} | {f"{name}_stated": _stated_sql(SQL[name]) for name in STATED}

_DATED = "published_at BETWEEN TIMESTAMPTZ '2021-01-01 00:00:00+00' AND TIMESTAMPTZ '2023-12-31 00:00:00+00'"
_FILTERS = {
    "news": _DATED, "repos": "doc_id % 1000 >= 300 AND lang = 'en'", "wiki": _DATED, "arxiv": f"source = 'arxiv_mirror' AND {_DATED}", "smallweb": f"source = 'smallweb_fernlog' AND {_DATED}",
    "docs": "source = 'docs_quarry'", "hn": f"n_chars % 500 >= 250 AND {_DATED}", "hf": f"source = 'hf_cards' AND {_DATED}", "memory": f"source = 'memory_notes' AND {_DATED}", "custom": _DATED, "unnamed": _DATED,
}
SQL |= {f"filter_{name}": f"SELECT doc_id FROM documents WHERE {where}" for name, where in _FILTERS.items()}
