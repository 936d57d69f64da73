"""Connected components of a table of links, in rounds of joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, deleted, saved

#: Rows of one key that any task may hold.
COLD = 10_000
#: So many links are solved in one task.
FEW = 50_000


def _moved(rows: DataFrame, step: DataFrame, end: str) -> DataFrame:
    """``rows`` with ``end`` replaced by where ``step(node, to, degree)`` sends
    it.  Nodes with over one in HOT_SHARE of all ends, fewer than HOT_SHARE,
    are joined by broadcast, so no task holds the rows of a hot node."""
    most, total = step.agg(F.max("degree"), F.sum("degree")).first()
    columns = [c for c in rows.columns if c != end]
    if most <= COLD:
        moves = step.select(F.col("node").alias(end), "to")
        return rows.join(moves, end).select(*columns, F.col("to").alias(end))
    hot = F.col("degree") * HOT_SHARE > total
    to_hot = step.where(hot).select(F.col("node").alias(end), F.col("to").alias("__hot"))
    rest = step.where(~hot).select(F.col("node").alias(end), "to")
    rows = rows.join(F.broadcast(to_hot), end, "left")
    plain = rows.where("__hot IS NULL").drop("__hot").join(rest, end)
    return plain.select(*columns, F.col("to").alias(end)).unionByName(
        rows.where("__hot IS NOT NULL").select(*columns, F.col("__hot").alias(end))
    )


def _solved(links: DataFrame) -> DataFrame:
    """(node, to) of at most FEW links, in one task: all nodes of a component
    go to the same one."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = sorted(root)
        yield pd.DataFrame({"node": nodes, "to": [find(x) for x in nodes]})

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").coalesce(1).mapInPandas(solve, f"node {kind}, to {kind}")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links(a, b)``: equal roots, one
    component.  Each round sends every node to the one of least hash among
    itself and its neighbours, and rewrites links and roots so; links inside a
    node go.  Hashes change with the round, so a fraction of the nodes is left
    each time, whatever the shape of the graph, and the last FEW links are
    solved in one task.  Nulls are no nodes.  Tables of a round go when the next
    one is written."""
    links = saved(links.dropna(subset=["a", "b"]).distinct(), "links")
    nodes = links.selectExpr("a AS node").union(links.selectExpr("b AS node")).distinct()
    roots = saved(nodes.selectExpr("node", "node AS root"), "roots")
    both = links.where("a <> b")
    seed = 0
    while n := both.count():
        if n <= FEW:
            moves = saved(_solved(both), "solved")
            before, to = roots, F.broadcast(moves.withColumnRenamed("node", "root"))  # at most 2 * FEW rows
            roots = saved(before.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            for table in (before, moves):
                deleted(table)
            break
        seed += 1
        rank = lambda c, s=seed: F.struct(F.xxhash64(F.lit(s), c).alias("r"), F.col(c).alias("n"))
        ends = both.unionAll(both.selectExpr("b AS a", "a AS b")).groupBy("a")
        step = ends.agg(F.least(F.min(rank("b")), F.first(rank("a")))["n"].alias("to"), F.count("*").alias("degree"))
        step = saved(step.withColumnRenamed("a", "node"), "step")
        sized = roots.groupBy("root").agg(F.count("*").alias("degree")).withColumnRenamed("root", "node")
        moves = saved(sized.join(step.drop("degree"), "node", "left").withColumn("to", F.coalesce("to", "node")), "moves")
        old = [links, step, moves, roots]
        roots = saved(_moved(roots, moves, "root").select("node", "root"), "roots")
        moved = _moved(_moved(both, step, "a"), step, "b")
        links = saved(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
        both = links
        for table in old:
            deleted(table)
    deleted(links)
    return roots
