"""Rule and finding graphs: directories as nodes, references as weighted edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import ids
from ruleloom.session import cut_lineage


def _allowed(directory: Column, namespaces: list[str] | None) -> Column:
    if namespaces is None:
        return F.lit(True)
    return F.lower(F.substring_index(directory, "/", 1)).isin(*[n.strip().lower() for n in namespaces])


def rule_graph(
    rules: DataFrame, conds: DataFrame, depth: int, namespaces: list[str] | None = None, min_refs: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Nodes (count, highest and mean criticality) and edges of composite rules."""
    source = ids.directory_at_depth(F.col("rule_id"), depth)
    kept = rules.withColumn("node", source).filter(_allowed(F.col("node"), namespaces))
    own = kept.groupBy("node").agg(
        F.count("*").alias("rules"), F.max("crit").alias("max_crit"), F.avg("crit").alias("mean_crit")
    )
    refs = conds.filter(F.col("clause").isin("all", "any", "none")).select(
        source.alias("src"), ids.directory_at_depth(F.col("ref_id"), depth).alias("dst")
    )
    linked = refs.filter(
        (F.col("src") != F.col("dst")) & _allowed(F.col("src"), namespaces) & _allowed(F.col("dst"), namespaces)
    )
    edges = linked.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    targets = edges.select(F.col("dst").alias("node")).distinct().join(own, "node", "left_anti")
    nodes = own.unionByName(
        targets.select("node", F.lit(0).cast("bigint").alias("rules"), F.lit(-1).alias("max_crit"), F.lit(0.0).alias("mean_crit"))
    )
    return nodes, edges.filter(F.col("weight") >= min_refs)


def findings_graph(
    findings: DataFrame, depth: int, min_crit: int = 0, namespaces: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes (matches, highest criticality, is_composite) and edges of findings.

    Findings are counted per id and references first, which is the size of the catalog,
    not of the findings; only those counts are regrouped by directory.
    """
    per_id = findings.filter(F.col("crit") >= min_crit).groupBy("rule_id", "trait_refs").agg(
        F.count("*").alias("n"), F.max("crit").alias("crit")
    )
    placed = per_id.withColumn("node", ids.directory_at_depth(F.col("rule_id"), depth)).filter(
        _allowed(F.col("node"), namespaces)
    )
    own = placed.groupBy("node").agg(
        F.sum("n").alias("match_count"), F.max("crit").alias("max_crit"), F.bool_or(F.size("trait_refs") > 0).alias("is_composite")
    )
    refs = placed.select("node", "n", F.explode("trait_refs").alias("ref")).withColumn(
        "dst", ids.directory_at_depth(F.col("ref"), depth)
    )
    edges = (
        refs.filter((F.col("dst") != F.col("node")) & _allowed(F.col("dst"), namespaces))
        .groupBy(F.col("node").alias("src"), "dst")
        .agg(F.sum("n").alias("weight"))
    )
    targets = edges.select(F.col("dst").alias("node")).distinct().join(own, "node", "left_anti")
    nodes = own.unionByName(
        targets.select("node", F.lit(0).cast("bigint").alias("match_count"), F.lit(-1).alias("max_crit"), F.lit(False).alias("is_composite"))
    )
    return nodes, edges


def graph_listing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by namespace, severity and count, each with its edges as text."""
    label = F.concat("dst", F.lit("(x"), "weight", F.lit(")"))
    out = edges.groupBy(F.col("src").alias("node")).agg(
        F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("refs")
    )
    return (
        nodes.join(out, "node", "left")
        .withColumn("namespace", F.substring_index("node", "/", 1))
        .withColumn("refs", F.coalesce("refs", F.lit("")))
        .orderBy("namespace", F.col("max_crit").desc(), F.col("match_count").desc(), "node")
    )


def heaviest_edges(edges: DataFrame, min_refs: int) -> DataFrame:
    return edges.filter(F.col("weight") >= min_refs).orderBy(F.col("weight").desc(), "src", "dst")


def _ends_meet(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges left after dropping nodes that nothing leads to or that lead nowhere, again and again."""
    size = edges.count()
    while size:
        starts, ends = edges.select(F.col(src).alias(dst)).distinct(), edges.select(F.col(dst).alias(src)).distinct()
        edges = cut_lineage(edges.join(starts, dst, "left_semi").join(ends, src, "left_semi"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def circle_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """The distinct edges that lie on a circle: both ends reach each other.

    Every node takes the largest name it can reach, forwards; a node that keeps its own is
    a root, and what it reaches among the nodes of its name is its strongly connected
    component. These are taken out and the rest goes on. Each step is a join and an
    aggregation over the edges; their number grows with the longest way.
    """
    edges = cut_lineage(edges.select(src, dst).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct())
    found = [edges.limit(0)]
    while True:
        edges = _ends_meet(edges, src, dst)
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, found)
        names = cut_lineage(edges.select(F.col(src).alias("node")).distinct().withColumn("name", F.col("node")))
        while True:
            ahead = edges.join(names.withColumnRenamed("node", dst), dst).groupBy(F.col(src).alias("node")).agg(F.max("name").alias("next"))
            moved = cut_lineage(names.join(ahead, "node").select("node", F.greatest("name", "next").alias("name"), (F.col("next") > F.col("name")).alias("moved")))
            names = moved.select("node", "name")
            if moved.where("moved").isEmpty():
                break
        named = edges.join(names.select(F.col("node").alias(src), F.col("name").alias("_a")), src).join(names.select(F.col("node").alias(dst), F.col("name").alias("_b")), dst)
        inner = cut_lineage(named.where("_a = _b").select(src, dst))
        reached = fresh = cut_lineage(names.where("node = name").select("node"))
        while not fresh.isEmpty():
            ahead = inner.join(fresh.withColumnRenamed("node", src), src).select(F.col(dst).alias("node")).distinct()
            fresh = cut_lineage(ahead.join(reached, "node", "left_anti"))
            reached = cut_lineage(reached.unionByName(fresh))
        member = lambda side: reached.withColumnRenamed("node", side)
        found.append(cut_lineage(inner.join(member(src), src, "left_semi").join(member(dst), dst, "left_semi")))
        edges = cut_lineage(edges.join(member(src), src, "left_anti").join(member(dst), dst, "left_anti"))
