"""Ready modules for flows over documents, and two flows that use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import document_hash, sanitize, text_hash
from corvane.functions.urls import canonical_news, sha1_suffix
from corvane.operators import dedup, filters
from corvane.plans.spec import FORM, Module, Param


def standard_modules(roots: dict[str, DataFrame], detector: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, Module]:
    """Modules over DataFrames with the columns suffix, url, canonical_url, title, text, lang and ordinal. ``roots`` are named
    inputs of discover nodes; ``detector`` gives ``(ordinal, detected)`` of documents without a label, which count as
    English where it is missing or can't tell."""

    def canonical(df: DataFrame, s: dict) -> DataFrame:
        df = df.withColumn("canonical_url", canonical_news(F.coalesce("canonical_url", "url")))
        if s["strategy"] == "field":
            return df.withColumn("suffix", F.coalesce(F.col("id").cast("string"), "suffix")) if "id" in df.columns else df
        return df.withColumn("suffix", sha1_suffix(F.col("canonical_url"))) if s["strategy"] == "sha1_of_canonical" else df

    def exact(df: DataFrame, s: dict) -> DataFrame:
        return dedup.exact_duplicates(df.withColumn("text_hash", document_hash(F.col("title"), F.col("text"))), "text_hash", "suffix", "ordinal")

    def near(df: DataFrame, s: dict) -> DataFrame:
        fresh = df.where("duplicate_of IS NULL") if "duplicate_of" in df.columns else df
        gone = dedup.greedy_duplicates(dedup.band_pairs(dedup.signature_bands(fresh, "ordinal", "text"), "ordinal", "ordinal").select("earlier", "later"))
        names = fresh.select(F.col("ordinal").alias("duplicate_of"), F.col("suffix").alias("_first"))
        named = gone.join(names, "duplicate_of").select(F.col("id").alias("ordinal"), "_first")
        out = df.join(named, "ordinal", "left")
        known = F.col("duplicate_of") if "duplicate_of" in df.columns else F.lit(None).cast("string")
        return out.withColumn("duplicate_of", F.coalesce(known, "_first")).drop("_first")

    def quality(df: DataFrame, s: dict) -> DataFrame:
        """Four gates in order; the page gate rewrites the text, and the line gate judges what is left."""
        repetitive = filters.repetition(df, "ordinal", "text").where("repetitive").select("ordinal")
        kept = df.join(repetitive, "ordinal", "left_anti").where((filters.quality_reason(F.col("text")) == "") & (filters.c4_reason(F.col("text")) == ""))
        kept = kept.withColumn("text", filters.c4_lines(F.col("text")))
        return kept.where(filters.fineweb_reason(F.col("text")) == "").select(*df.columns)

    def language(df: DataFrame, s: dict) -> DataFrame:
        if detector is not None:
            told = detector(df.where(F.coalesce(F.trim("lang"), F.lit("")) == "").select("ordinal", "text")).select("ordinal", F.col("detected").alias("_detected"))
            df = df.join(told, "ordinal", "left").withColumn("lang", F.coalesce(F.when(F.trim("lang") != "", F.col("lang")), "_detected")).drop("_detected")
        return df.where(filters.language_allowed(F.col("lang"), tuple(x.strip().lower() for x in s["allowed"].split(",") if x.strip())))

    def boilerplate(df: DataFrame, s: dict) -> DataFrame:
        return dedup.keep_first(df, text_hash(F.coalesce("text", F.lit(""))), "ordinal", s["repeat_cap"])

    return {
        "root": Module("discover", lambda _, s: roots[s["name"]], {"name": Param("str", required=True)}),
        "pass.fetch": Module("fetch", lambda df, s: df),
        "pass.extract": Module("extract", lambda df, s: df),
        "push.docs": Module("receive", lambda df, s: df),
        "text.sanitize": Module("transform", lambda df, s: df.withColumn("text", sanitize(F.col("text")))),
        "canonical.url": Module("transform", canonical, {"strategy": Param("choice", "sha1_of_canonical", choices=("sha1_of_canonical", "path_suffix", "field"))}),
        "dedup.exact": Module("transform", exact),
        "dedup.minhash": Module("transform", near),
        "dedup.boilerplate": Module("transform", boilerplate, {"repeat_cap": Param("int", 2, low=1, high=100)}),
        "filter.lang": Module("transform", language, {"allowed": Param("csv", "en")}),
        "filter.length": Module("transform", lambda df, s: df.where(filters.long_enough(F.col("text"), s["min_chars"])), {"min_chars": Param("int", 200, low=0, high=1_000_000)}),
        "filter.quality": Module("transform", quality),
        "ledger.stage": Module("load", lambda df, s: df),
    }


def _chain(*steps: tuple[str, str, str, dict]) -> dict:
    nodes = {name: {"kind": kind, "uses": uses, "with": settings} for name, kind, uses, settings in steps}
    names = [s[0] for s in steps]
    return {"nodes": nodes, "edges": [{"from": {"node": a}, "to": {"node": b}} for a, b in zip(names, names[1:], strict=False)]}


#: News: canonical URL, exact then near duplicates, staged.
NEWS = {
    "schema": FORM,
    "flows": {"ingest": _chain(
        ("due", "discover", "root", {"name": "documents"}), ("get", "fetch", "pass.fetch", {}), ("read", "extract", "pass.extract", {}), ("clean", "transform", "text.sanitize", {}),
        ("canonical", "transform", "canonical.url", {}), ("exact", "transform", "dedup.exact", {}), ("near", "transform", "dedup.minhash", {}), ("stage", "load", "ledger.stage", {}),
    )},
}
#: Crawl: at most two pages with the same text, then staged.
CRAWL = {
    "schema": FORM,
    "flows": {"ingest": _chain(
        ("due", "discover", "root", {"name": "documents"}), ("get", "fetch", "pass.fetch", {}), ("read", "extract", "pass.extract", {}),
        ("repeat", "transform", "dedup.boilerplate", {"repeat_cap": 2}), ("length", "transform", "filter.length", {"min_chars": 200}), ("stage", "load", "ledger.stage", {}),
    )},
}
