"""Ranking quality. ``ranked`` is (query_id, doc_id, rank from 1), ``judged`` is (query_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gains(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    return ranked.join(judged.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def dcg(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1)


def metrics(queries: DataFrame, ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """``(query_id, ndcg, mrr, recall, precision, hit)`` for every row of ``queries``.

    nDCG has linear gain and an ideal order over all judged grades, cut at k; MRR looks at the whole list; precision
    divides by k. A query without relevant documents, or k <= 0, scores 0.
    """
    if k <= 0:
        return queries.select("query_id", *[F.lit(0.0).alias(m) for m in ("ndcg", "mrr", "recall", "precision", "hit")])
    relevant = F.col("grade") > 0
    found = _gains(ranked, judged).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, dcg(F.col("grade"), F.col("rank")))).alias("dcg"), F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.count(F.when(relevant & (F.col("rank") <= k), 1)).alias("hits"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc()))
    ideal = judged.withColumn("place", place).groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, dcg(F.col("grade"), F.col("place")))).alias("idcg"), F.count(F.when(relevant, 1)).alias("relevant"))
    rows = queries.select("query_id").join(found, "query_id", "left").join(ideal, "query_id", "left")
    over = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    return rows.select(
        "query_id", over(F.col("dcg"), F.col("idcg")).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), over(F.col("hits"), F.col("relevant")).alias("recall"),
        F.coalesce(F.col("hits") / F.lit(k), F.lit(0.0)).alias("precision"), F.coalesce((F.col("hits") > 0).cast("double"), F.lit(0.0)).alias("hit"),
    )


def means(scores: DataFrame, by: tuple[str, ...] = (), columns: tuple[str, ...] = ("ndcg", "mrr", "recall", "precision", "hit")) -> DataFrame:
    return scores.groupBy(*by).agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in columns], F.count("*").alias("queries"))


def overall(by_source: DataFrame, columns: tuple[str, ...] = ("ndcg", "mrr", "recall", "precision", "hit")) -> DataFrame:
    """Mean over sources, each counting once."""
    return by_source.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in columns])


def seeded_order(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows with the least md5 of key and seed: the same sample wherever it is drawn."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def block_sample(df: DataFrame, key: str, n: int, fraction: float = 0.01, seed: int = 1) -> DataFrame:
    """A quick sample of about ``fraction``; where that gives too few rows, the seeded order."""
    some = df.sample(fraction, seed).limit(n)
    return some if some.count() >= n else seeded_order(df, key, str(seed), n)


def stratified(df: DataFrame, source: str, key: str, weights: dict[str, float], total: int, seed: str = "") -> DataFrame:
    """max(1, round(total * w / sum of w)) rows per source, least md5 first."""
    whole = sum(weights.values())
    size = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(max(1, round(total * w / whole))))])
    at = Window.partitionBy(source).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key)
    return df.where(F.col(source).isin(*weights)).withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= size[F.col(source)]).drop("_n")


def hard_negatives(ranked: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """The n best-ranked documents of each query that aren't relevant to it."""
    wrong = ranked.join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    at = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return wrong.withColumn("place", F.row_number().over(at)).where(F.col("place") <= n)


def guardrail(scored: DataFrame, junk_below: float) -> DataFrame:
    """``scored`` is (query_id, doc_id, kind in positive, negative, junk, score): one row with the verdict of a judge."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    score = lambda kind: F.when(F.col("kind") == kind, F.col("score"))
    per = scored.withColumn("rank", F.row_number().over(order)).groupBy("query_id").agg(
        F.min(F.when(F.col("kind") == "positive", F.col("rank"))).alias("first"), F.max(score("junk")).alias("junk"), F.min(score("positive")).alias("positive")
    )
    out = per.agg(
        F.max("junk").alias("junk_max"), F.min("positive").alias("pos_min"),
        F.round(F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")), 6).alias("top1"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
    return out.withColumn("passed", F.coalesce((F.col("junk_max") < junk_below) & (F.col("pos_min") > F.col("junk_max")), F.lit(False)))


def judge_grade(answer: Column) -> Column:
    """Grade 0 to 3 from the first digit of a judge's answer; null without one."""
    d = F.regexp_extract(answer, r"([0-9])", 1)
    return F.when(d != "", F.least(d.cast("int"), F.lit(3)))
