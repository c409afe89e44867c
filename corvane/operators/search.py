"""Filtered lexical, dense and hybrid top-k retrieval, for many queries in one plan.

Ranks are cut with a row number over each query; Spark keeps only k rows per query and input partition before it
shuffles, so no query gathers all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import words
from corvane.session import Scratch, at_most, bounded_rows, broadcast_if_small, least_hashed


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "doc_id") -> DataFrame:
    """``scores`` with ``rank``: the k best rows of each group, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- lexical ---------------------------------------------------------------------------------------------------------
def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, few: int = 5_000) -> DataFrame:
    """``(query_id, doc_id, score)`` of every document that shares a word with a query.

    ``queries`` gives ``query_id, query``. The texts are read and cut into words once: each document keeps its length and
    those of its words that a query asks for, which is written to scratch and serves totals, document frequencies and
    postings alike. Up to ``few`` different words are looked up inside the array; more of them meet the words in a join.
    idf is ln(1 + (N - df + 0.5) / (df + 0.5)); a word that a query repeats counts as often as it stands there.
    """
    terms = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    scratch = Scratch(docs.sparkSession, "bm25")
    terms = scratch.keep(terms, "terms")
    named = [r[0] for r in terms.select("term").distinct().limit(few + 1).collect()]
    cut = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), words(F.col(text)).alias("w"))
    if len(named) <= few:
        sized = scratch.keep(cut.select("doc_id", F.filter("w", lambda x: x.isin(named)).alias("w"), F.size("w").alias("dl")), "words")
        found = sized.select("doc_id", "dl", F.explode("w").alias("term"))
    else:
        sized = cut.withColumn("dl", F.size("w"))
        listed = broadcast_if_small(terms.select("term").distinct(), 100_000)
        found = sized.select("doc_id", "dl", F.explode("w").alias("term")).join(listed, "term", "left_semi")
    postings = scratch.keep(found.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    totals = sized.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).alias("t")).scalar()
    weights = terms.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("t", totals).select("*", "t.n", "t.avgdl")
    weights = weights.select("query_id", "term", "avgdl", (F.col("qtf") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    weights = F.broadcast(weights) if at_most(terms, 100_000) else weights  # no more rows than the terms
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25_of_many(docs: DataFrame, queries: DataFrame, k: int | None = None, by: str | None = None, digits: int | None = None, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, block: int = 16_384, most: int = 4_000_000) -> DataFrame:
    """``(query_id, doc_id[, by], score[, rank])``: scores of ``bm25`` for a set of queries that grows with the table.

    Queries and documents that share a word are then so many pairs that they can't be shuffled. Here each task meets
    ``block`` documents with all queries, one sum per query over the lists of its words, and passes on its ``k`` best rows per
    query (and value of the column ``by``); without ``k`` every pair, which nothing gathers. The texts are read once; what
    is kept of a document is its length and the numbers of the words that a query asks for. ``digits`` rounds scores before
    they are ranked. ``key`` names a document, so its values differ. Words of queries are held in memory, at most about ``most`` at once:
    more queries are taken in rounds, each of which reads the texts.
    """
    scratch = Scratch(docs.sparkSession, "bm25")
    terms = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = scratch.keep(terms, "terms")
    rounds = -(-terms.count() // most) or 1
    cut = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), *([by] if by else []), words(F.col(text)).alias("w"))
    got = None
    for r in range(rounds):
        part = terms if rounds == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
        one = _bm25_round(scratch, cut, part, k, by, digits, k1, b, block)
        got = one if got is None else got.union(one)
    return got if k is None else top_k(got, k, by=("query_id", *([by] if by else [])))


def _bm25_round(scratch: Scratch, cut: DataFrame, terms: DataFrame, k: int | None, by: str | None, digits: int | None, k1: float, b: float, block: int) -> DataFrame:
    """``(query_id, doc_id[, by], score)`` of at most ``k`` rows per task, query and value of ``by`` beside ties that the next step cuts."""
    context = cut.sparkSession.sparkContext
    asked = terms.toArrow().combine_chunks().sort_by([("query_id", "ascending"), ("term", "ascending")])
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    named, who = one(asked["term"]).dictionary_encode(), one(asked["query_id"]).dictionary_encode(null_encoding="encode")
    vocabulary, size = context.broadcast(named.dictionary), max(1, len(named.dictionary))
    head = [(f.name, f.dataType.simpleString()) for f in cut.schema if f.name != "w"]
    fields = ", ".join(f"`{n}` {kind}" for n, kind in head)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            w = x.column(x.num_columns - 1)
            flat, length = w.flatten(), pc.list_value_length(w).to_numpy(zero_copy_only=False)
            t = pc.index_in(flat, value_set=vocabulary.value.cast(flat.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
            row = np.repeat(np.arange(x.num_rows), length)
            row, t, tf = _counted(row[t >= 0], t[t >= 0], size)
            offsets = pa.array(np.searchsorted(row, np.arange(x.num_rows + 1)).astype("int32"))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype("int32"))) for v in (t, tf)]
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(length.astype("int32")), *lists], names=[*[n for n, _ in head], "dl", "t", "tf"])

    sized = scratch.keep(cut.mapInArrow(find, f"{fields}, dl int, t array<int>, tf array<int>"), "postings")
    n, total = sized.agg(F.count("*"), F.sum("dl")).first()
    df = np.zeros(size)
    for t, many in sized.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*")).collect():  # no more rows than the words asked for
        df[t] = many
    average = (total or 0) / n if n and total else 1.0
    t = named.indices.to_numpy(zero_copy_only=False)
    weight = asked["qtf"].to_numpy() * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
    starts = np.searchsorted(who.indices.to_numpy(zero_copy_only=False), np.arange(len(who.dictionary) + 1))
    shared = context.broadcast((who.dictionary, starts, t, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, t, weight = shared.value
        least: dict = {}  # per value of ``by``: for each query a score that k rows have reached
        for x in _gathered(batches, block):
            order = pc.sort_indices(x, sort_keys=[(n, "ascending") for n, _ in reversed(head)], null_placement="at_start")
            x = x.take(order)
            col = lambda name, x=x: x.column(name).combine_chunks()
            lists, tf = col("t"), col("tf").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(x.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            dl = col("dl").to_numpy(zero_copy_only=False)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / average))
            post = _Postings(lists.flatten().to_numpy(zero_copy_only=False), row, part, x.num_rows, size)
            parts = [(None, 0, x.num_rows)]
            if by:
                runs = pc.run_end_encode(col(by))
                ends = runs.run_ends.to_pylist()
                parts = list(zip(runs.values.to_pylist(), [0, *ends[:-1]], ends))
            for value, _, _ in parts:
                if value not in least:
                    least[value] = np.zeros(len(ids))
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            rows = 0
            for q in range(len(ids)):
                sums = post.sums(t[starts[q] : starts[q + 1]], weight[starts[q] : starts[q + 1]])
                if sums is None:
                    continue
                for value, at, end in parts:
                    where, s = _best(sums[at:end], k, digits, least[value], q)
                    if len(where):
                        held.append((q, where + at, s))
                        rows += len(where)
                if rows >= 100_000:
                    yield _pairs(held, ids, x, head)
                    held, rows = [], 0
            if held:
                yield _pairs(held, ids, x, head)

    return sized.mapInArrow(score, f"query_id {terms.schema['query_id'].dataType.simpleString()}, {fields}, score double").select("query_id", *[n for n, _ in head], "score")


def _counted(row: np.ndarray, t: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, numbers of words and how often they stand there, in this order."""
    code, many = np.unique(row * size + t, return_counts=True)
    return code // size, code % size, many


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to tables of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        held.append(x)
        if sum(y.num_rows for y in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(y.num_rows for y in held):
        yield pa.Table.from_batches(held)


class _Postings:
    """Lists of the words of one block: rows and their share of the score; those of frequent words stand over all rows."""

    def __init__(self, t: np.ndarray, row: np.ndarray, part: np.ndarray, rows: int, size: int) -> None:
        order = np.argsort(t, kind="stable")
        self.row, self.part, self.ends = row[order], part[order], np.searchsorted(t[order], np.arange(size + 1))
        self.total, self.one, self.wide = np.zeros(rows), np.zeros(rows), {}

    def sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
        """Score of each row for one query, 0 where it has none of its words; None if no row has one. Valid until the next call."""
        any_of = False
        for t, w in zip(terms.tolist(), weights.tolist()):
            at, end = self.ends[t], self.ends[t + 1]
            if at == end:
                continue
            if not any_of:
                self.total[:] = 0
                any_of = True
            if (end - at) * 8 < len(self.total):
                self.total[self.row[at:end]] += w * self.part[at:end]
                continue
            if t not in self.wide:
                self.wide[t] = np.zeros(len(self.total))
                self.wide[t][self.row[at:end]] = self.part[at:end]
            np.multiply(self.wide[t], w, out=self.one)
            self.total += self.one
        return self.total if any_of else None


def _best(sums: np.ndarray, k: int | None, digits: int | None, least: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best positive sums, the first ones among equals, or of all. ``least[q]`` is raised to the k-th."""
    room = 0.0 if digits is None else 10.0**-digits  # what rounding can move
    where = np.flatnonzero((sums > 0) & (sums >= least[q] - room)) if k is not None and least[q] > room else np.flatnonzero(sums > 0)
    s = sums[where]
    if k is not None and len(s) > k:
        some = s >= np.partition(s, len(s) - k)[len(s) - k] - room
        where, s = where[some], s[some]
    if digits is not None:
        s = np.floor(s * 10.0**digits + 0.5) / 10.0**digits
    if k is not None and len(s) >= k:
        best = np.argsort(-s, kind="stable")[:k]
        where, s = where[best], s[best]
        least[q] = max(least[q], s[-1])
    return where, s


def _pairs(held: list[tuple[int, np.ndarray, np.ndarray]], ids: pa.Array, x: pa.Table, head: list) -> pa.RecordBatch:
    q, where = np.repeat([q for q, _, _ in held], [len(w) for _, w, _ in held]), pa.array(np.concatenate([w for _, w, _ in held]))
    columns = [x.column(n).combine_chunks().take(where) for n, _ in head]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *columns, pa.array(np.concatenate([s for _, _, s in held]))], names=["query_id", *[n for n, _ in head], "score"])


# --- dense -----------------------------------------------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None, block: int = 512, max_queries: int = 1_000_000) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: exact cosine search of a stated query set against all rows.

    ``queries`` gives ``query_id, embedding``, at most ``max_queries``. The vectors are read once; each Arrow batch meets the
    queries in blocks of ``block`` vectors, one matrix product each, and passes on only its k best rows per query. ``where`` filters documents before
    they are scored. Null vectors and vectors without length have no cosine and are left out.
    """
    rows = docs.where(where) if where is not None else docs
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("doc_id"), vector)
    wanted = [(r[0], np.asarray(r[1], "float64")) for r in bounded_rows(queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding"), max_queries, "queries")]
    q_kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_kind}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"
    wanted = [(i, v / np.linalg.norm(v)) for i, v in wanted if np.linalg.norm(v) > 0]
    blocks = [(pa.array([i for i, _ in wanted[at : at + block]]).cast(_arrow(q_kind)), np.array([v for _, v in wanted[at : at + block]])) for at in range(0, len(wanted), block)]
    shared = docs.sparkSession.sparkContext.broadcast(blocks)  # at most ``max_queries`` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(b.num_rows, -1)
            n = np.linalg.norm(x, axis=1)
            keep = np.flatnonzero(n > 0)
            if not len(keep):
                continue
            x, names, top = x[keep] / n[keep, None], b.column(0).take(pa.array(keep)), min(k, len(keep))
            for ids, m in shared.value:
                s = x @ m.T
                # all rows that tie with the k-th best stay, the id decides between them later
                level = np.partition(s, len(keep) - top, axis=0)[len(keep) - top]
                r, c = np.nonzero(s >= level[None, :] - 1e-12)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c)), names.take(pa.array(r)), pa.array(s[r, c])], names=["query_id", "doc_id", "score"])

    return top_k(rows.mapInArrow(run, schema), k)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


@dataclass
class ClusterIndex:
    """Vectors by nearest centre. Centres come from k-means on a bounded sample; every row is indexed, none is left out.

    ``probes`` is measured on the sample (``_probes_for``): vectors without structure need half of the clusters, clear
    groups a few."""

    centres: np.ndarray
    rows: DataFrame  # cluster, doc_id, embedding
    probes: int

    @classmethod
    def build(cls, docs: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = 64, sample: int = 20_000, rounds: int = 12, seed: int = 5) -> ClusterIndex:
        """Fit on the ``sample`` rows with the least hash of their key."""
        some = least_hashed(docs.where(F.col(vector).isNotNull()).select(key, vector), F.xxhash64(F.col(key), F.lit(seed)), sample).toPandas()
        x = np.array(some[vector].tolist(), "float64").reshape(len(some), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centres = x[: min(clusters, len(x))].copy()
        for _ in range(rounds if len(x) else 0):
            near = (x @ centres.T).argmax(1)
            for c in range(len(centres)):
                if (near == c).any():
                    m = x[near == c].mean(0)
                    centres[c] = m / max(np.linalg.norm(m), 1e-12)
        probes = _probes_for(x, centres)
        shared = docs.sparkSession.sparkContext.broadcast(centres)
        schema = f"cluster int, doc_id {docs.schema[key].dataType.simpleString()}, embedding array<float>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array((v @ shared.value.T).argmax(1).astype("int32")), b.column(0), b.column(1)], names=["cluster", "doc_id", "embedding"])

        return cls(centres, docs.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>")).mapInArrow(run, schema), probes)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``(query_id, doc_id, score, rank)`` from the ``probes`` nearest clusters of each query, by join on the cluster; by
        default as many as find nine in ten of the ten best rows."""
        probes = probes or self.probes
        wanted = queries.select("query_id", "embedding")
        shared = queries.sparkSession.sparkContext.broadcast(self.centres)
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, cluster int, q array<float>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(b.num_rows, -1)
                    near = np.argsort(-(v @ shared.value.T), axis=1)[:, :probes]
                    again = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(again), pa.array(near.ravel().astype("int32")), b.column(1).take(again)], names=["query_id", "cluster", "q"])

        probed = wanted.select("query_id", F.col("embedding").cast("array<float>")).mapInArrow(run, schema)
        return top_k(self.rows.join(probed, "cluster").select("query_id", "doc_id", cosine(F.col("q"), F.col("embedding")).alias("score")), k)


def _probes_for(x: np.ndarray, centres: np.ndarray, k: int = 10, recall: float = 0.9, asked: int = 400) -> int:
    """Least number of clusters in which ``asked`` rows of the sample find ``recall`` of their k best other rows, with two
    standard errors to spare. Among more rows than the sample the best are nearer, so it doesn't find less there."""
    q, k = x[-asked:], min(k, len(x) - 1)
    if k < 1:
        return max(1, len(centres))
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(x) - len(q), len(x))] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
    depth = np.take_along_axis(place, (x @ centres.T).argmax(1)[best], axis=1)
    for probes in range(1, len(centres)):
        found = (depth < probes).mean(1)
        if found.mean() - 2 * found.std() / np.sqrt(len(q)) >= recall:
            return probes
    return len(centres)


# --- fusion, filters, shaping ----------------------------------------------------------------------------------------
def reciprocal_rank_fusion(legs: list[DataFrame], k: int, k0: int = 60) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` with score = sum over legs of 1 / (k0 + rank)."""
    union = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        union = union.union(leg.select("query_id", "doc_id", "rank"))
    return top_k(union.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k0 + F.col("rank"))).alias("score")), k)


#: What each profile of sources can be filtered by; other parameters are ignored for it.
PROFILES: dict[str, tuple[str, ...]] = {
    "news": ("published",), "repos": ("min_stars", "language"), "wiki": ("published",), "arxiv": ("primary_category", "published"), "smallweb": ("outlet", "published"),
    "docs": ("framework",), "hn": ("min_points", "published"), "hf": ("root", "kind", "published"), "memory": ("conversation_id", "published"), "custom": ("published",),
}


def payload_filter(profile: str, **params) -> Column:
    """Conjunction of the filters that the profile knows; a document without the field fails its condition. Dates are
    inclusive; empty strings and zeros ask for nothing. A source with a profile of its own name filters like a custom one."""
    out = F.lit(True)
    for name in PROFILES.get(profile, PROFILES["custom"]):
        if name == "published":
            if params.get("published_from") is not None:
                out = out & (F.col("published_at") >= F.lit(params["published_from"]).cast("timestamp"))
            if params.get("published_to") is not None:
                out = out & (F.col("published_at") <= F.lit(params["published_to"]).cast("timestamp"))
        elif params.get(name):
            out = out & (F.col(name.removeprefix("min_")) >= params[name] if name.startswith("min_") else F.col(name) == params[name])
    return out


def fan_out(scores: DataFrame, sources: DataFrame, per_source: int, limit: int) -> DataFrame:
    """Best rows over all sources that are enabled and take part, each source giving at most ``per_source`` of a query."""
    taking = sources.where("enabled AND include_in_all").select("source")
    best = top_k(scores.join(taking, "source", "left_semi"), per_source, by=("query_id", "source")).drop("rank")
    return top_k(best, limit)


def rerank(results: DataFrame, scorer: Callable[[Column, Column], Column], limit: int, query: str = "query", body: str = "body") -> DataFrame:
    """Results with the score of another judge; what it can't score counts 0."""
    return top_k(results.drop("rank").withColumn("score", F.coalesce(scorer(F.col(query), F.col(body)), F.lit(0.0))), limit)


def overlap_scorer(query: Column, body: Column) -> Column:
    """Share of the query's distinct words that stand in the body."""
    q = F.array_distinct(words(query))
    return F.size(F.array_intersect(q, words(body))) / F.greatest(F.size(q), F.lit(1))


def search(docs: DataFrame, queries: DataFrame, mode: str = "hybrid", limit: int = 10, where: Column | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, oversample: int = 4) -> tuple[DataFrame, dict]:
    """``(results, info)``. The filter holds for both legs before they are ranked; each leg gives ``limit * oversample`` rows.

    Without vectors a hybrid search becomes lexical and says so in ``info``; a dense one raises.
    """
    info = {"mode": mode, "degraded": False}
    if vectors is None or query_vectors is None:
        if mode == "dense":
            raise ValueError("a dense search needs vectors")
        if mode == "hybrid":
            info = {"mode": "lexical", "degraded": True}
    rows = docs.where(where) if where is not None else docs
    if info["mode"] == "lexical":
        return top_k(bm25(rows, queries), limit), info
    allowed = vectors.join(rows.select(F.col("doc_id")), "doc_id", "left_semi") if where is not None else vectors
    if mode == "dense":
        return dense_top_k(allowed, query_vectors, limit, key="doc_id"), info
    legs = [top_k(bm25(rows, queries), limit * oversample), dense_top_k(allowed, query_vectors, limit * oversample, key="doc_id")]
    return reciprocal_rank_fusion(legs, limit), info


def get_document(ledger: DataFrame, staged: DataFrame, doc_id: str) -> DataFrame:
    """Ledger row and stored body of one document; the id filter reaches both scans."""
    return ledger.where(F.col("id") == doc_id).join(staged.where(F.col("id") == doc_id).select("id", "text"), "id", "left")
