"""Lines that one site repeats across its documents.

Lines are nodes, known by their source and by their letters alone; two lines that follow each other are joined by an edge.
Nodes and edges that enough different documents hold are kept, and the connected components of what is left are the
boilerplate blocks of a site. Every occurrence of a line of a block is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import Scratch, broadcast_if_small


def letters_of(line: Column) -> Column:
    """Letters of a line in lower case, everything else left out."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def counted_lines(df: DataFrame, key: str, source: str, text: str, least_letters: int) -> DataFrame:
    """``(id, place, line_no, node, check)`` of the lines that count; place numbers them within their document."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda line, i: F.struct((i + 1).alias("line_no"), letters_of(line).alias("letters")))
    lines = F.filter(lines, lambda x: F.length(x["letters"]) >= least_letters)
    rows = df.where(F.col(key).isNotNull() & F.col(source).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).alias("id"), F.col(source).alias("site"), F.posexplode(lines).alias("place", "x"))
    return rows.select("id", "place", F.col("x.line_no").alias("line_no"), F.xxhash64("site", "x.letters").alias("node"), F.hash("x.letters", "site").alias("check"))


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``(node, block)``: smallest node of the connected component, by label spreading with pointer jumping.

    ``edges`` is symmetric (a, b). A round lets every node take the least label around it, then the label of its label, so
    a chain of n lines needs about log n rounds. Each round is written to shared storage.
    """
    labels = scratch.keep(nodes.select("node", F.col("node").alias("block")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels.withColumnsRenamed({"node": "b", "block": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = labels.join(near, "node", "left").select("node", F.least("block", F.coalesce("near", "block")).alias("block"), F.col("block").alias("old"))
        jump = labels.select(F.col("node").alias("block"), F.col("block").alias("next"))
        after = scratch.keep(least.join(jump, "block", "left").select("node", F.least("block", F.coalesce("next", "block")).alias("block"), "old"), "labels")
        moved = after.where("block <> old").limit(1).count()
        labels = after.select("node", "block")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def repeated_lines(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", least_documents: int = 5, least_letters: int = 12, edge_documents: int = 5, small: int = 500_000
) -> DataFrame:
    """``(id, line_no, block, documents)``: every occurrence of a line that at least ``least_documents`` documents of one source hold.

    Lines are the same if their letters, in lower case, are; lines with fewer than ``least_letters`` letters don't count.
    Support is counted over distinct documents with partial aggregation first, so neither a source nor a line that holds
    a third of all rows gathers in one task. Blocks with at most ``small`` nodes are broadcast, larger ones joined by
    shuffle. Rows with a null key, source or text have no lines; repeated rows count as one document; an empty table
    gives no rows; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "sitelines")
    lines = counted_lines(df, key, source, text, least_letters)
    support = lines.groupBy("node", "check").agg(F.count_distinct("id").alias("documents")).where(F.col("documents") >= least_documents)
    nodes = scratch.keep(support, "nodes")
    held = scratch.keep(lines.join(broadcast_if_small(nodes, small), ["node", "check"]).distinct(), "occurrences")
    by_document = Window.partitionBy("id").orderBy("place")
    steps = held.select("id", "place", "node", F.lead("place").over(by_document).alias("next_place"), F.lead("node").over(by_document).alias("next"))
    steps = steps.where("next_place = place + 1 AND next <> node").select("id", F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b"))
    kept = steps.groupBy("a", "b").agg(F.count_distinct("id").alias("weight")).where(F.col("weight") >= edge_documents)
    edges = scratch.keep(kept.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"), "edges")
    blocks = components(nodes.select("node").distinct(), edges, scratch)
    return held.join(broadcast_if_small(blocks, small), "node").select("id", "line_no", "block", "documents")


def without_lines(df: DataFrame, occurrences: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the given lines cut out of ``text``; all columns and rows stay."""
    free = lambda name: name if name not in df.columns else free(name + "_")
    at, cut = free("_id"), free("_gone")
    gone = occurrences.groupBy(F.col("id").alias(at)).agg(F.collect_set("line_no").alias(cut))  # no larger than the document
    lines = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(cut, (i + 1)))
    kept = F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    return df.join(gone, F.col(key) == F.col(at), "left").withColumn(text, kept).drop(at, cut)
