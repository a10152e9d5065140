import numpy as np
from conftest import rows

from factlake.operators import graph as G, labels as L, mapping as M, ranking as R, skew, store

C = [("x", "P31", "a"), ("a", "P279", "b"), ("b", "P279", "c"), ("c", "P279", "a"), ("y", "P31", "c"), ("x", "P17", "q"), ("y", "P17", "q"), ("z", "P17", "q"), ("x", "P17", "q")]


def claims(spark, c=C):
    return spark.createDataFrame(c, "head string, prop string, tail string")


def test_closure_with_a_cycle(spark):
    assert rows(G.type_closure(claims(spark))) == sorted([(h, t) for h in "xy" for t in "abc"])
    assert rows(G.type_closure(claims(spark).where("false"))) == []


def test_boolean(spark):
    c = claims(spark)
    ask = lambda s, **k: [r[0] for r in rows(G.boolean_search(c, s, **k))]
    assert ask([("and", "P17", "q"), ("and", "P31", "a")]) == ["x"]
    assert ask([("and", "P31", "a"), ("or", "P31", "c")], order="declared") == ["x", "y"]
    assert ask([("and", None, "q"), ("not", "P31", "a")], order="declared") == ["y", "z"]
    assert ask([("and", "P17", "q"), ("and", "P17", "nowhere")], missing="ignore") == ["x", "y", "z"]
    assert ask([("and", "P17", "q"), ("and", "P17", "nowhere")], missing="empty") == []
    assert ask([("not", "P31", "a"), ("and", "P17", "q")]) == ["x"]  # by size, the smallest seeds the result
    assert ask([]) == []


def test_inverted_index(spark):
    got = rows(G.inverted_index(claims(spark)))
    assert ("q", "P17", 3) in got and ("q", None, 3) in got and ("c", None, 2) in got


def dense(edges, alpha, steps, reverse):
    ids = sorted({x for e in edges for x in e[:2]})
    a = np.zeros((len(ids), len(ids)))
    for s, d, w in edges:
        a[(ids.index(d), ids.index(s)) if reverse else (ids.index(s), ids.index(d))] += w
    r, n, x = a.sum(1), len(ids), np.ones(len(ids))
    z = ((1 - alpha) * (r != 0) + (r == 0)) / n
    for _ in range(steps):
        x = alpha * (a / np.where(r == 0, 1, r)[:, None]).T @ x + z @ x
    return dict(zip(ids, x / x.sum()))


def test_pagerank(spark):
    edges = [("a", "b", 1), ("b", "c", 3), ("c", "a", 1), ("c", "c", 1), ("a", "d", 3)]
    df = spark.createDataFrame(edges, "src string, dst string, w long")
    for reverse in (False, True):
        got = {r.id: r.score for r in G.pagerank(df, iterations=2, reverse=reverse).collect()}
        want = dense(edges, 0.85, 2, reverse)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        assert abs(sum(r.score for r in G.pagerank(df, reverse=reverse, tol=1e-4).collect()) - 1) < 1e-9
    assert G.pagerank(df.where("false"), iterations=1).count() == 0


def test_mapping(spark):
    d = M.build_dictionary(spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "x string"), "x")
    assert rows(d) == [("a", 0), ("b", 1), ("c", 2)]
    red = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    assert rows(M.resolve(keys, red, "k")) == [("b",), ("c",), ("z",)]
    t = spark.createDataFrame([("b", "vb"), ("z", "vz")], "k string, v string")
    assert rows(M.lookup_with_fallback(keys, "k", t, "v", red)) == [("a", "vb"), ("b", "vb"), ("z", "vz")]
    m = lambda *x: spark.createDataFrame(x, "k string, v string")
    assert rows(M.prefer([m(("a", "1"), ("b", "1")), m(("a", "2"), ("a", "3"))], "k", "v")) == [("a", "2"), ("b", "1")]


def test_store(spark):
    t = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), (None, "9")], "k string, v string")
    more = spark.createDataFrame([("a", "2"), ("c", "3"), ("c", None)], "k string, v string")
    assert rows(store.merge_set(t, more, "k", "v")) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "3")]
    assert rows(store.delete_keys(t, more, ["k"])) == [("b", "1"), (None, "9")]
    assert rows(store.put(t, more.dropna(), ["k"])) == [("a", "2"), ("b", "1"), ("c", "3"), (None, "9")]
    n = lambda *x: spark.createDataFrame(x, "k string, n long")
    assert rows(store.merge_counter(n(("a", 1), ("b", None)), n(("a", 2)), "k", "n")) == [("a", 3), ("b", 0)]
    assert rows(store.multi_get(t, more, "k")) == [("a", "1"), ("a", "2")]


def test_salted_join(spark):
    left = spark.range(20_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 100 = 1 then null else concat('k', id % 5000) end as k", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int")
    assert skew.hot_hashes(left, ["k"])
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.salted_join(left, right, ["k"], how)) == rows(skew.salted_join(left, right, ["k"], how, [])) == rows(left.join(right, ["k"], how))


def test_search(spark, tmp_path):
    lab = spark.createDataFrame([("Q1", "en", "Old Mill"), ("Q2", "en", "Old Mill"), ("P3", "all", "old mill"), ("Q1", "en", "Q5"), ("Q4", "en", None)], "id string, scope string, label string")
    v = L.vocabulary(lab)
    assert rows(v) == [("P3", "all", "old mill"), ("Q1", "en", "old mill"), ("Q2", "en", "old mill")]
    sc = spark.createDataFrame([("Q2", 5.0)], "id string, score double")
    r = L.label_ranking(v, sc, spark.createDataFrame([("Q1",)], "tail string"))
    assert rows(r.select("kind", "id", "rank")) == [("entity", "Q2", 1), ("property", "P3", 1), ("type", "Q1", 1)]
    q = spark.createDataFrame([("od mill",), ("zzz",), ("",)], "text string")
    hits = L.fuzzy(q, L.delete_index(v.select("label"), 2, 10), 2, 10)
    assert rows(hits) == [("od mill", "old mill", 0.875)]
    e = L.entity_search(hits, r.select("label", "id", "score"), lab.select("id", "label"), v)
    assert [x[1] for x in sorted(rows(e.select("rank", "id")))] == ["Q2", "Q1", "P3"]  # P3 has no English label
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, None), (4, "")], "doc int, text string")
    asked = spark.createDataFrame([("q", "a b"), ("n", "zz")], "query string, text string")
    assert rows(L.bm25(L.build_index(docs), asked)) == [("q", 1, 1.0), ("q", 2, 0.0)]
    L.build_index(docs, str(tmp_path / "index"))
    kept = L.open_index(spark, str(tmp_path / "index"))
    assert (kept.n_docs, kept.mean_len) == (2, 2.5) and rows(L.bm25(kept, asked)) == [("q", 1, 1.0), ("q", 2, 0.0)]
    assert rows(L.bm25(L.build_index(docs.where("false")), asked)) == []
    own = L.entity_search(spark.createDataFrame([("q7", "x", 0.5)], "text string, label string, score double"), r.select("label", "id", "score"), lab.select("id", "label"), v)
    assert rows(own.select("text", "id", "score")) == [("q7", "Q7", 1.0)]
    full = spark.createDataFrame([("t", "a", 0.9), ("t", "b", 0.1)], "text string, label string, score double")
    near = spark.createDataFrame([("t", "b", 0.8), ("u", "c", 0.3)], "text string, label string, score double")
    both = {(x.text, x.label): x.score for x in L.label_hits(full, near, "a").collect()}
    assert abs(both["t", "a"] + both["t", "b"] - 1) < 1e-12 and both["t", "b"] > both["t", "a"] and both["u", "c"] == 1.0
    assert rows(L.label_hits(full, near, "b")) == rows(full) and rows(L.label_hits(full, near, "f")) == rows(near)
    assert rows(L.labels_of(v, spark.createDataFrame([("Q1",)], "id string"), "en")) == [("Q1", ["old mill"])]
    assert rows(L.available(v, spark.createDataFrame([("OLD  mill",), ("new",)], "text string"))) == [("OLD  mill",)]
    assert rows(L.query_variants(spark.createDataFrame([(1, "x (y) [z]")], "query int, text string")).select("text", "weight")) == sorted([("x (y)", 0.99), ("x (y) [z]", 1.0), ("x [z]", 1.0), ("y", 1.0)], key=repr)
    ranks = spark.createDataFrame([("l", i, float(-i)) for i in range(3)], "l string, item int, score double")
    assert abs(sum(x.p for x in R.rank_to_p(ranks, "l", "item", "score").collect()) - 1) < 1e-12


def test_ranking_modes(spark):
    import math

    ranks = spark.createDataFrame([("l", "a", 2.0), ("l", "b", 1.0), ("l", "c", 1.0), ("m", "a", 800.0)], "l string, item string, score double")
    p = lambda mode, limit=None: {(x.l, x.item): x.p for x in R.rank_to_p(ranks, "l", "item", "score", limit, mode).collect()}
    e = math.exp(2) + 2 * math.exp(1)
    assert abs(p(R.SCORE)["l", "a"] - math.exp(2) / e) < 1e-12 and p(R.SCORE)["m", "a"] == 1.0
    assert p(R.EQUAL)["l", "b"] == 1 / 3 and len(p(R.EQUAL, 2)) == 3 and p(R.EQUAL, 2)["l", "b"] == 0.5
    assert [round(x.p, 3) for x in R.average(ranks.where("l = 'l'"), ["l"], "score").orderBy("item").collect()] == [0.5, 0.25, 0.25]


def test_more_of_the_store(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("b", "1"), ("d", "9"), ("d", None)], "k string, v string")
    assert rows(store.update_sets(old, new, "k", "v")) == [("a", ["1", "2"], "update"), ("b", ["1"], "skip"), ("c", ["1"], "kept"), ("d", ["9"], "new")]
    t = spark.createDataFrame([("ab", 1), ("b", 2), (None, 3)], "k string, n int")
    assert rows(store.prefix_delete(t, "k", "a")) == [("b", 2), (None, 3)]
    assert [(r.k, r.value.n) for r in store.items(t.dropna(), "k").orderBy("k").collect()] == [("ab", 1), ("b", 2)]
    r = store.describe({"t": t.dropna(), "none": t.where("false")}, {"t": 77}).orderBy("name").collect()
    assert [(x.name, x.n_rows, x.n_columns, x.types, x.first, x.n_bytes) for x in r] == [("none", 0, 2, "k:string,n:int", None, None), ("t", 2, 2, "k:string,n:int", '{"k":"ab","n":1}', 77)]


def test_boolean_preview(spark):
    c = spark.createDataFrame([("Q1", "P1", "Q9"), ("Q2", "P1", "Q9"), ("Q2", "P2", "Q8"), ("Q3", "P2", "Q8")], "head string, prop string, tail string")
    todo = [(G.AND, "P1", "Q9"), (G.NOT, None, "Q8"), (G.OR, "P2", "Q8")]
    got = G.boolean_search(c, todo, order="declared")
    assert rows(got) == [("Q1",), ("Q2",), ("Q3",)]
    lab = spark.createDataFrame([("Q9", "nine"), ("P1", "is"), ("Q1", "one")], "id string, label string")
    assert {r.line for r in G.preview(got, lab, todo, 2).collect()} == {"and P1[is] - Q9[nine]", "not - Q8[]", "or P2[] - Q8[]", "answer"}
    assert rows(G.preview(got, lab, todo, 2).where("line = 'answer'").select("id", "label")) == [("Q1", "one"), ("Q2", None)]


def test_personal_pagerank(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "a", 2), ("a", "d", 1)], "src string, dst string, w int")
    p = spark.createDataFrame([("c", 3.0), ("nowhere", 1.0)], "id string, weight double")
    got = {r.id: r.score for r in G.pagerank(e, reverse=False, personal=p).collect()}
    x, n = {"a": 0.0, "b": 0.0, "c": 4.0, "d": 0.0}, 4
    out = {"a": ["b", "d"], "b": ["a"], "c": ["a"], "d": []}
    for _ in range(300):
        z = sum(v * (0.15 if out[k] else 1) for k, v in x.items()) / n
        x = {k: z * (4.0 if k == "c" else 0.0) + 0.85 * sum(x[u] / len(o) for u, o in out.items() if k in o) for k in x}
    assert all(abs(got[k] - x[k] / 4) < 1e-6 for k in x)


def test_ranked(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 50) end as k", "id", "id % 11 as s")
    got = skew.ranked(df, ["k"], [skew.F.col("s").desc(), skew.F.col("id")]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.k, []).append(r)
    assert len(got) == 3000
    for g in groups.values():
        assert [(r.s, r.id) for r in sorted(g, key=lambda r: r.rank)] == sorted(((r.s, r.id) for r in g), key=lambda x: (-x[0], x[1])) and sorted(r.rank for r in g) == list(range(1, len(g) + 1))
    assert [r.id for r in store.positions(df, "id", 5, 8).orderBy("id").collect()] == [5, 6, 7]
    assert skew.ranked(df.where("false"), [], [skew.F.col("id")]).count() == 0


def test_random_and_compact(spark, tmp_path):
    t = spark.range(1000).selectExpr("id", "id % 7 as k")
    a, b = store.random_rows(t, 5, 1), store.random_rows(t, 5, 2)
    assert a.count() == 5 and rows(a) != rows(b)
    store.compact(t, str(tmp_path / "t"), ["k", "id"], 3)
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(t)
