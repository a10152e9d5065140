"""Claims as a labelled graph: postings, boolean search, types, weights, PageRank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators.skew import SALTS, hot_hashes, salted_join
from factlake.session import cut, cut_observed, drop_cut

#: Edges, and characters of their ids, of a graph that PageRank iterates in one task.
ONE_TASK_EDGES, ONE_TASK_CHARS = 8_000_000, 200_000_000


def claims_of(claims: DataFrame, heads: DataFrame | None = None, prop: str | None = None) -> DataFrame:
    """Claims of some heads (column head), of one property, or both."""
    c = claims if prop is None else claims.where(F.col("prop") == prop)
    return c if heads is None else c.join(heads.select("head").distinct(), "head", "left_semi")


def posting(claims: DataFrame, tail: str, prop: str | None = None) -> DataFrame:
    """(head): heads with this tail, under one property or any."""
    c = claims.where(F.col("tail") == tail)
    return (c if prop is None else c.where(F.col("prop") == prop)).select("head").distinct()


def inverted_index(claims: DataFrame) -> DataFrame:
    """(tail, prop, n_heads) and, with prop null, (tail, n_heads over all properties)."""
    per = claims.select("tail", "prop", "head").distinct()
    by_prop = per.groupBy("tail", "prop").agg(F.count(F.lit(1)).alias("n_heads"))
    any_prop = per.select("tail", "head").distinct().groupBy("tail").agg(F.count(F.lit(1)).alias("n_heads"))
    return by_prop.unionByName(any_prop.select("tail", F.lit(None).cast("string").alias("prop"), "n_heads"))


AND, OR, NOT = "and", "or", "not"


def boolean_search(claims: DataFrame, statements: list[tuple[str, str | None, str]], order: str = "size", missing: str = "ignore") -> DataFrame:
    """(head) of the heads that fulfil the statements (operator, property or None for any, tail).

    One pass: claims that any statement names are pushed down to the scan and grouped by head; sizes are observed while the
    heads are written. A left fold: the first posting seeds the result whatever its operator; then `and` intersects, `or` adds, `not` takes
    away. order='size' sorts the statements by the size of their posting first (ties as declared), 'declared' keeps
    them. missing: a statement without postings is left out ('ignore') or empty ('empty'). No statements give no rows.
    """
    asked = [(F.col("tail") == t) & (F.lit(True) if p is None else F.col("prop") == p) for _, p, t in statements]
    if not asked:
        return claims.select("head").where(F.lit(False))
    any_of = asked[0]
    for a in asked[1:]:
        any_of = any_of | a
    number = F.explode(F.filter(F.array(*[F.when(a, F.lit(i)) for i, a in enumerate(asked)]), lambda x: x.isNotNull())).alias("i")
    per_head = claims.where(any_of & F.col("head").isNotNull()).select("head", number).groupBy("head").agg(F.collect_set("i").alias("has"))
    fulfils = [F.array_contains("has", i) for i in range(len(asked))]
    heads, sizes = cut_observed(per_head, **{f"s{i}": F.count(F.when(x, 1)) for i, x in enumerate(fulfils)})
    todo = list(range(len(statements)))
    if missing == "ignore":
        todo = [i for i in todo if sizes[f"s{i}"]]
    if order == "size":
        todo.sort(key=lambda i: sizes[f"s{i}"])
    holds = None
    for i in todo:
        op = statements[i][0]
        holds = fulfils[i] if holds is None else holds | fulfils[i] if op == OR else holds & ~fulfils[i] if op == NOT else holds & fulfils[i]
    return heads.where(F.lit(False) if holds is None else holds).select("head")


def preview(heads: DataFrame, labels: DataFrame, statements: list[tuple[str, str | None, str]], k: int = 3) -> DataFrame:
    """(line, id, label): the statements of a search with the labels of what they name, then its first k heads by id."""
    spark = heads.sparkSession
    asked = spark.createDataFrame([(i, op, p, t) for i, (op, p, t) in enumerate(statements)], "i int, op string, prop string, tail string")
    main = labels.select("id", "label").groupBy("id").agg(F.min("label").alias("label"))
    names = lambda c: main.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    q = asked.join(names("prop"), "prop", "left").join(names("tail"), "tail", "left")
    text = F.concat(F.col("op"), F.when(F.col("prop").isNotNull(), F.concat(F.lit(" "), "prop", F.lit("["), F.coalesce("prop_label", F.lit("")), F.lit("]"))).otherwise(""), F.lit(" - "), "tail", F.lit("["), F.coalesce("tail_label", F.lit("")), F.lit("]"))
    first = heads.select(F.col("head").alias("id")).orderBy("id").limit(k).join(main, "id", "left")
    return q.select(text.alias("line"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label")).unionByName(first.select(F.lit("answer").alias("line"), "id", "label"))


def types_in_use(claims: DataFrame) -> DataFrame:
    """(tail): everything that is a class of something."""
    return claims.where("prop = 'P279'").select("tail").distinct()


def reachable(edges: DataFrame, max_steps: int = 40) -> DataFrame:
    """(src, dst): everything that can be reached from a node by one or more edges, by doubling: log2(depth) joins.

    A pair at a distance beyond 2^k is made of one at a distance of just 2^k, which the last step has found, and a nearer
    one; so each step joins the last step's new pairs with all there are, and writes only new ones. Cycles are safe: it
    ends when no pair is new. Pairs at much frequented nodes are spread over tasks. Rows with a null are left out.
    """
    size = F.count(F.lit(1))
    fresh, seen = cut_observed(edges.select("src", "dst").dropna().distinct(), n=size)
    every, hot = fresh, hot_hashes(fresh, ["dst"])
    for _ in range(max_steps):
        if not seen["n"]:
            return every
        a, b = fresh.select("src", F.col("dst").alias("mid")), every.select(F.col("src").alias("mid"), "dst")
        more = salted_join(a, b, ["mid"], "inner", hot).select("src", "dst").distinct()
        fresh, seen = cut_observed(more.join(every.hint("merge"), ["src", "dst"], "left_anti"), n=size)
        every = every.unionByName(fresh)
    raise RuntimeError(f"not closed after {max_steps} steps")


def type_closure(claims: DataFrame) -> DataFrame:
    """(head, type): classes of every head by P31, and the classes above those by P279; cycles are safe."""
    up = reachable(claims.where("prop = 'P279'").select(F.col("head").alias("src"), F.col("tail").alias("dst")))
    direct = claims.where("prop = 'P31'").select("head", F.col("tail").alias("type"))
    above = direct.join(up, direct["type"] == up["src"]).select("head", F.col("dst").alias("type"))
    return direct.unionByName(above).distinct()


def edge_weights(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """(src, dst, w): the weights of all parts (src, dst) with their weight a row, summed."""
    both = None
    for p, w in parts:
        x = p.select("src", "dst").dropna().groupBy("src", "dst").agg((F.count(F.lit(1)) * w).alias("w"))
        both = x if both is None else both.unionByName(x)
    return both.groupBy("src", "dst").agg(F.sum("w").cast("bigint").alias("w"))


def _iterate(batches: Iterator[pa.RecordBatch], told: bool, alpha: float, iterations: int | None, tol: float, max_iter: int) -> Iterator[pa.RecordBatch]:
    """pagerank() of all batches (src, dst, w) in this task; told: rows without a dst are personal weights of src."""
    t = pa.Table.from_batches(batches)
    is_edge = pc.is_valid(t["dst"])
    own, t = t.filter(pc.invert(is_edge)), t.filter(is_edge)
    m, w = len(t), t["w"].to_numpy()
    both = pc.dictionary_encode(pa.chunked_array(t["src"].chunks + t["dst"].chunks, t.schema.field("src").type)).unify_dictionaries()
    names, code = both.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in both.chunks])
    del t, both
    n, src, dst = len(names), code[:m], code[m:]
    total = np.bincount(src, w, n)
    gives, total = total > 0, np.where(total > 0, total, 1.0)
    order = np.argsort(dst, kind="stable")
    src, w, dst = src[order], w[order], dst[order]
    heads = np.flatnonzero(np.diff(dst, prepend=-1))
    into = dst[heads]
    del code, order, dst
    s = np.ones(n)
    if told:
        at = pc.index_in(own["src"], value_set=names)
        known = pc.is_valid(at)
        s = np.bincount(at.filter(known).to_numpy(), own["w"].filter(known).to_numpy(), n)
    scale = s.sum() / n
    if not scale:
        return
    x = s
    for _ in range(iterations or max_iter):
        dangling = x[~gives].sum() / scale
        new = ((1 - alpha) * (n - dangling) + dangling) / n * s
        new[into] += alpha * np.add.reduceat((x / total)[src] * w, heads)
        change = np.sqrt((((new - x) / scale) ** 2).sum())
        x = new
        if iterations is None and change <= tol:
            break
    score = pa.array(x / (n * scale))
    for i in range(0, n, 100_000):
        yield pa.RecordBatch.from_arrays([names[i : i + 100_000], score[i : i + 100_000]], ["id", "score"])


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int | None = None, tol: float = 1e-6, reverse: bool = True, max_iter: int = 1000, personal: DataFrame | None = None, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, score) of weighted edges (src, dst, w); scores sum to 1.

    x <- alpha * A'D^-1 x + the rest by s, from x = s; ends when the 2-norm of the change is at most tol, or after
    `iterations` steps. s is even, or as `personal` (id, weight) says, where nodes not listed have none. reverse: rank
    flows from dst to src. A graph of up to `one_task` edges is read into one task as numbers and iterated there, since its
    steps take less than a job does. Of a larger one edges are laid out by source once, those of hot sources by target too;
    each step shuffles scores and what they give, in one shuffle each, and writes the scores to the shared folder.
    """
    rows = edges.select(F.col("dst" if reverse else "src").alias("src"), F.col("src" if reverse else "dst").alias("dst"), "w")
    odd = F.col("src").isNull() | F.col("dst").isNull() | ~F.coalesce(F.col("w") > 0, F.lit(False))
    given, size = cut_observed(rows, n=F.count(F.lit(1)), odd=F.count(F.when(odd, 1)), chars=F.sum(F.length(F.col("src").cast("string")) + F.length(F.col("dst").cast("string"))))
    if 0 < (size["n"] or 0) <= one_task and not size["odd"] and (size["chars"] or 0) <= ONE_TASK_CHARS:
        e = given.select("src", "dst", F.col("w").cast("double").alias("w"))
        if personal is not None:
            own = personal.where("id is not null and weight is not null").select("id", F.col("weight").cast("double"))
            e = e.unionByName(own.select(F.col("id").cast(e.schema["src"].dataType).alias("src"), F.lit(None).cast(e.schema["dst"].dataType).alias("dst"), F.col("weight").alias("w")))
        told = personal is not None
        steps = e.coalesce(1).mapInArrow(lambda batches: _iterate(batches, told, alpha, iterations, tol, max_iter), T.StructType([T.StructField("id", e.schema["src"].dataType), T.StructField("score", T.DoubleType())]))
        x, seen = cut_observed(steps, n=F.count(F.lit(1)))
        drop_cut(given)
        if not seen["n"]:
            raise ValueError("no weight in personal belongs to a node")
        return x
    e = given
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    hot = hot_hashes(e, ["src"])
    is_hot = lambda c: F.xxhash64(c).isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot("src"), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    e = salted_join(e, out, ["src"], "inner", hot).select("src", salt.alias("salt"), "dst", (F.col("w") / F.col("total")).alias("share")).repartition("src", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    gives = out.select(F.col("src").alias("id"), F.lit(True).alias("gives"))
    first = gives.unionByName(e.select(F.col("dst").alias("id"), F.lit(False).alias("gives"))).groupBy("id").agg(F.max("gives").alias("gives"))
    if personal is None:
        first = first.withColumn("s", F.lit(1.0))
    else:
        p = personal.groupBy("id").agg(F.sum("weight").cast("double").alias("s"))
        first = first.join(p, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    lost = F.sum(F.when(~F.col("gives"), F.col("score")))
    x, seen = cut_observed(first.withColumn("score", F.col("s")), n=F.count(F.lit(1)), total=F.sum("s"), dangling=lost)
    n, scale = seen["n"] or 0, (seen["total"] or 0.0) / (seen["n"] or 1)
    if n and not scale:
        raise ValueError("no weight in personal belongs to a node")
    for _ in range(iterations or max_iter):
        dangling = (seen["dangling"] or 0.0) / (scale or 1.0)
        rest = ((1 - alpha) * (n - dangling) + dangling) / n if n else 0.0
        send = x.select(F.col("id").alias("src"), "score", F.explode(F.when(is_hot("id"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        none = F.lit(None)
        got = e.join(send.hint("shuffle_hash"), ["src", "salt"]).select(F.col("dst").alias("id"), none.cast("boolean").alias("gives"), none.cast("double").alias("s"), none.cast("double").alias("was"), (F.col("share") * F.col("score")).alias("got"))
        own = x.select("id", "gives", "s", F.col("score").alias("was"), none.cast("double").alias("got"))
        both = own.unionByName(got).groupBy("id").agg(F.max("gives").alias("gives"), F.max("s").alias("s"), F.max("was").alias("was"), F.sum("got").alias("got"))
        step = both.select("id", "gives", "s", (alpha * F.coalesce("got", F.lit(0.0)) + rest * F.col("s")).alias("score"), "was")
        new, seen = cut_observed(step, dangling=lost, change=F.sum(F.pow((F.col("score") - F.col("was")) / (scale or 1.0), 2)))
        drop_cut(x)
        x = new
        if iterations is None and (seen["change"] or 0.0) ** 0.5 <= tol:
            break
    e.unpersist()
    drop_cut(given)
    return x.select("id", (F.col("score") / (n * scale or 1.0)).alias("score"))
