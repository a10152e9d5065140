import os
import random

import pytest
from conftest import DATA, rows

from factlake.operators import hierarchy as H
from factlake.plans import problems


def brute(edges):
    up, nodes = {}, set()
    for g, c, p in edges:
        if None in (g, c, p):
            continue
        nodes |= {(g, c), (g, p)}
        k = (g, c)
        if k not in up or (len(p), p) < (len(up[k]), up[k]):
            up[k] = p
    out, below = {}, {n: set() for n in nodes}
    for g, n in nodes:
        path, at = [n], n
        while (g, at) in up and up[g, at] not in path:
            at = up[g, at]
            path.append(at)
        if (g, at) in up:
            out[g, n] = ("", -1, None)
        else:
            out[g, n] = (path[-1], len(path) - 1, path[::-1])
            for a in path[1:]:
                below[g, a].add(n)
    return sorted((g, n, r, d, len(below[g, n]) if d >= 0 else -1, p) for (g, n), (r, d, p) in out.items())


def run(spark, edges):
    df = spark.createDataFrame([(*e, "x", 1) for e in edges], "prop string, head string, tail string, node string, g int")
    h = H.hierarchy(df, "prop", "head", "tail", paths=True)
    got = sorted((r["g"], r["node"], r["root"], r["depth"], r["n_below"], r["path"]) for r in h.collect())
    return h, got


def test_trees_chains_cycles(spark):
    rnd = random.Random(3)
    edges = [("a", f"n{i}", f"n{i + 1}") for i in range(25)]  # a chain
    edges += [("a", f"l{i}", "n3") for i in range(12)]  # many leaves under one node
    edges += [("b", f"t{i}", f"t{rnd.randrange(i)}") for i in range(1, 60)]  # a random tree
    edges += [("b", "c1", "c2"), ("b", "c2", "c3"), ("b", "c3", "c1"), ("b", "d1", "c2"), ("b", "d2", "d1")]  # a cycle with a tail
    edges += [("a", "self", "self"), ("a", "under", "self")]
    edges += [("a", "n0", "n1")] * 3 + [("a", None, "n1"), ("a", "q", None), (None, "q", "r")]
    h, got = run(spark, edges)
    assert got == brute(edges)
    pairs = rows(H.descendants(h).select("g", "ancestor", "node", "distance"))
    assert pairs == sorted(((g, a, n, len(p) - 1 - i) for g, n, _, _, _, p in got if p for i, a in enumerate(p[:-1])), key=repr)


def test_several_parents_keep_the_smallest(spark):
    _, got = run(spark, [("a", "x", "p10"), ("a", "x", "p9")])
    assert ("a", "x", "p9", 1, 0, ["p9", "x"]) in got and ("a", "p10", "p10", 0, 0, ["p10"]) in got


def test_empty(spark):
    assert run(spark, [])[1] == []
    assert run(spark, [("a", None, None)])[1] == []


def test_spare_links(spark):
    df = spark.createDataFrame([("a", "x", "p10"), ("a", "x", "p9"), ("a", "x", "p9"), ("a", "y", "x"), ("b", "x", None)], "prop string, head string, tail string")
    assert rows(H.spare_links(df, "prop", "head", "tail")) == [("a", "x", "p10", "p9")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_rounds_and_plan(spark, monkeypatch):
    """Contraction makes the rows at the smallest scale too, and no join is left to be broadcast."""
    rounds, plans = [], []
    real = H._round

    def counted(a, seed, paths):
        out = real(a, seed, paths)
        rounds.append(seed)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(H, "_round", counted)
    h = H.hierarchy(problems._tree_links(spark, DATA), "prop", "head", "tail")
    assert h.count() > 0 and len(rounds) > 3
    assert all("BroadcastHashJoin" not in p for p in plans)
