"""Parent-child links to full hierarchies by tree contraction.

Each round rakes all leaves into their parents and splices out of unary chains every node whose random number is
larger than those of its parent and child (so no two neighbours go at once). That removes a constant share of the
nodes, so the number of rounds grows with the logarithm of their number, however deep the trees are. Reversing the
recorded rounds gives root, depth, size and path. A cycle shrinks to a node that is its own parent, which nothing
removes: what is left when no round changes anything are the roots and the cores of the cycles.

Each round is one table in the shared folder; rounds shrink geometrically, so all tables together are a small multiple
of the input. Rounds go on until no node is left with a parent, at every size of input; nothing is gathered in one task.
Joins are told to be sort-merge joins: what a round leaves may be small, but nothing proves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.skew import hot_hashes, salted_join
from factlake.session import cut, cut_observed, drop_cut


def _clean(edges: DataFrame, group: str, child: str, parent: str) -> DataFrame:
    return edges.select(F.col(group).alias("g"), F.col(child).alias("node"), F.col(parent).alias("parent")).dropna()


def parent_links(links: DataFrame) -> DataFrame:
    """One row (g, node, parent) a node: of several parents the smallest by length and text, so that it is a forest."""
    return links.groupBy("g", "node").agg(F.min(F.struct(F.length("parent").alias("n"), F.col("parent").alias("p"))).alias("m")).select("g", "node", F.col("m.p").alias("parent"))


def spare_links(edges: DataFrame, group: str, child: str, parent: str) -> DataFrame:
    """(g, node, parent, kept): the links that hierarchy() leaves out because the node has a smaller parent, which is `kept`."""
    every = _clean(edges, group, child, parent).distinct()
    kept = parent_links(every).withColumnRenamed("parent", "kept")
    return every.join(kept.hint("merge"), ["g", "node"]).where("parent <> kept").select("g", "node", "parent", "kept")


def _start(every: DataFrame, paths: bool) -> DataFrame:
    links = parent_links(every)
    # parents that no child kept are nodes too
    kids = links.select("g", F.col("parent").alias("node"), F.lit(1).alias("n")).unionByName(every.select("g", F.col("parent").alias("node"), F.lit(0).alias("n"))).groupBy("g", "node").agg(F.sum("n").alias("nk"))
    via = F.expr("cast(array() as array<string>)") if paths else F.lit(None).cast("array<string>")
    return links.join(kids, ["g", "node"], "full").select(
        "g", "node", "parent", F.lit(1).alias("dist"), F.lit(0).cast("bigint").alias("skip"), F.lit(0).cast("bigint").alias("acc"),
        F.coalesce("nk", F.lit(0).cast("bigint")).alias("nk"), via.alias("via"),
        F.lit(None).cast("string").alias("cut_node"), F.lit(None).cast("bigint").alias("cut_acc"), F.lit(None).cast("bigint").alias("cut_skip"), F.lit(None).cast("int").alias("cut_dist"),
    )


_LEAF = "nk = 0 and parent is not null"


def _round(a: DataFrame, seed: int, paths: bool) -> DataFrame:
    leaf = F.expr(_LEAF)
    gains = a.where("parent is not null").groupBy("g", F.col("parent").alias("node")).agg(
        F.sum(F.when(leaf, F.col("acc") + 1 + F.col("skip")).otherwise(F.lit(0))).alias("gain"),
        F.count(F.when(~leaf, 1)).alias("left"),
        F.max(F.when(~leaf, F.col("node"))).alias("child"),
    )
    b = a.where(~leaf).join(gains.hint("merge"), ["g", "node"], "left").select("g", "node", "parent", "dist", "skip", (F.col("acc") + F.coalesce("gain", F.lit(0))).alias("acc"), F.coalesce("left", F.lit(0).cast("bigint")).alias("nk"), "via", "child")
    rank = lambda c: F.xxhash64("g", c, F.lit(seed))
    b = b.withColumn("gone", F.coalesce((F.col("nk") == 1) & (F.col("parent") != F.col("node")) & (rank("node") > rank("parent")) & (rank("node") > rank("child")), F.lit(False)))
    v = b.where("gone").select("g", F.col("child").alias("node"), F.col("parent").alias("vp"), F.col("dist").alias("vd"), (F.col("acc") + 1 + F.col("skip")).alias("vs"), F.col("node").alias("vn"), F.col("acc").alias("va"), F.col("via").alias("vv"))
    via = F.when(F.col("vn").isNotNull(), F.concat("vv", F.array("vn"), "via")).otherwise(F.col("via")) if paths else F.col("via")
    return b.where("not gone").join(v.hint("merge"), ["g", "node"], "left").select(
        "g", "node", F.coalesce("vp", "parent").alias("parent"), (F.col("dist") + F.coalesce("vd", F.lit(0))).alias("dist"), (F.col("skip") + F.coalesce("vs", F.lit(0))).alias("skip"), "acc", "nk", via.alias("via"),
        F.col("vn").alias("cut_node"), F.col("va").alias("cut_acc"), F.when(F.col("vn").isNotNull(), F.col("skip")).alias("cut_skip"), F.when(F.col("vn").isNotNull(), F.col("dist")).alias("cut_dist"),
    )


def hierarchy(edges: DataFrame, group: str, child: str, parent: str, paths: bool = False, max_rounds: int = 500) -> DataFrame:
    """(g, node, root, depth, n_below[, path]) of every node of every link.

    root: the topmost node; depth: links up to it; n_below: number of different nodes below; path: nodes from the root
    down to the node. Where the way up never ends (cycles and all below them) root is the empty string, depth and
    n_below are -1 and path is null. Rows with a null are left out, repeated ones count once, of several parents the
    smallest counts (spare_links() lists the others), a row that links a node to itself is a cycle. No rows give no rows. Other columns are ignored.
    path is as long as the node is deep; leave it off where trees may be deep and only the figures are wanted.
    """
    climbing = F.count(F.when(F.expr("parent is not null and parent <> node"), 1))
    a, seen = cut_observed(_start(_clean(edges, group, child, parent), paths), n=climbing)
    hot = hot_hashes(a.where("parent is not null").select("g", F.col("parent").alias("node")), ["g", "node"])
    rounds = [a]
    while seen["n"]:
        if len(rounds) > max_rounds:
            raise RuntimeError(f"not contracted after {max_rounds} rounds")
        a, seen = cut_observed(_round(a, len(rounds), paths), n=climbing)
        rounds.append(a)
    # What is left are roots, each a tree of one node by now, and cycles of one node.
    top = F.expr("parent is null")
    s = cut(a.where(f"not ({_LEAF})").select(
        "g", "node", F.when(top, F.col("node")).otherwise("").alias("root"), F.when(top, 0).otherwise(-1).alias("depth"), F.when(top, F.col("acc")).otherwise(F.lit(-1).cast("bigint")).alias("n_below"),
        *([F.when(top, F.array("node")).alias("path")] if paths else []),
    ))
    ends = F.col("root") != ""
    s0 = s
    for r in range(len(rounds) - 1, 0, -1):
        spliced = rounds[r].where("cut_node is not null").join(s.hint("merge"), ["g", "node"]).select(
            "g", F.col("cut_node").alias("node"), "root", F.when(ends, F.col("depth") - F.col("cut_dist")).otherwise(-1).alias("depth"), F.when(ends, F.col("cut_acc") + F.col("cut_skip") + 1 + F.col("n_below")).otherwise(F.lit(-1).cast("bigint")).alias("n_below"),
            *([F.slice("path", F.lit(1), F.col("depth") - F.col("cut_dist") + 1).alias("path")] if paths else []),
        )
        s = s.unionByName(spliced)
        up = s.select("g", F.col("node").alias("parent"), "root", "depth", *(["path"] if paths else []))
        leaves = rounds[r - 1].where(_LEAF).select("g", F.col("node").alias("leaf"), F.col("parent"), "dist", "acc", "via")
        raked = salted_join(leaves, up.hint("merge"), ["g", "parent"], "inner", hot).select(
            "g", F.col("leaf").alias("node"), "root", F.when(ends, F.col("depth") + F.col("dist")).otherwise(-1).alias("depth"), F.when(ends, F.col("acc")).otherwise(F.lit(-1).cast("bigint")).alias("n_below"),
            *([F.concat("path", "via", F.array("leaf")).alias("path")] if paths else []),
        )
        before, s = s0, cut(s.unionByName(raked))
        drop_cut(rounds.pop(), before)
        s0 = s
    return s


def descendants(resolved: DataFrame) -> DataFrame:
    """(g, ancestor, node, distance): every node below every node, from hierarchy(..., paths=True)."""
    return resolved.where("path is not null").select("g", "node", "depth", F.posexplode("path").alias("i", "ancestor")).where("i < depth").select("g", "ancestor", "node", (F.col("depth") - F.col("i")).alias("distance"))
