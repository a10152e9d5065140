"""Dictionaries of ids, redirects and maps between bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.skew import ranked, salted_join


def build_dictionary(ids: DataFrame, col: str) -> DataFrame:
    """(id, lid): dense numbers from 0 in the order of the ids. Nulls are left out, repeated ids count once."""
    d = ids.select(F.col(col).alias("id")).dropna().distinct()
    return ranked(d, [], [F.col("id")], "lid").select("id", (F.col("lid") - 1).cast("bigint").alias("lid"))


def encode(rows: DataFrame, dictionary: DataFrame, cols: list[str]) -> DataFrame:
    """Replace the columns by their numbers; rows with an unknown or null part are dropped."""
    for c in cols:
        rows = salted_join(rows, dictionary.select(F.col("id").alias(c), F.col("lid").alias(f"{c}_lid")), [c], "inner").drop(c).withColumnRenamed(f"{c}_lid", c)
    return rows


def decode(rows: DataFrame, dictionary: DataFrame, col: str) -> DataFrame:
    """Replace numbers by ids; unknown numbers become null."""
    return rows.join(dictionary.select(F.col("lid").alias(col), F.col("id").alias("_id")), col, "left").drop(col).withColumnRenamed("_id", col)


def resolve(rows: DataFrame, redirect: DataFrame, col: str) -> DataFrame:
    """One hop: the redirect's target, or the value itself where it has no redirect. redirect: (src, dst), unique src."""
    r = redirect.select(F.col("src").alias(col), F.col("dst").alias("_dst"))
    return salted_join(rows, r, [col], "left").withColumn(col, F.coalesce("_dst", col)).drop("_dst")


def redirects_of(redirect: DataFrame) -> DataFrame:
    """(dst, src): all sources of a target."""
    return redirect.select("dst", "src").distinct()


def lookup_with_fallback(keys: DataFrame, key: str, table: DataFrame, value: str, redirect: DataFrame) -> DataFrame:
    """(key, value): the key's own value, else that of the page it redirects to, else null. Only misses are looked up twice."""
    t = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    first = keys.select(key).distinct().join(t, F.col(key) == F.col("_k"), "left").drop("_k")
    hit, miss = first.where("_v is not null").select(key, F.col("_v").alias(value)), first.where("_v is null").select(key)
    second = resolve(miss.withColumn("_to", F.col(key)), redirect, "_to").join(t, F.col("_to") == F.col("_k"), "left").select(key, F.col("_v").alias(value))
    return hit.unionByName(second)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, c) of maps (a, b) and (b, c)."""
    return first.join(second, "b").select("a", "c").distinct()


def prefer(maps: list[DataFrame], key: str, value: str) -> DataFrame:
    """One value a key: that of the last map that has one, of several the smallest."""
    both = None
    for i, m in enumerate(maps):
        part = m.select(key, value, F.lit(i).alias("_o"))
        both = part if both is None else both.unionByName(part)
    best = both.dropna().groupBy(key, "_o").agg(F.min(value).alias(value))
    return best.groupBy(key).agg(F.max_by(value, "_o").alias(value))


def page_item_map(pages: DataFrame, props: DataFrame, redirect: DataFrame) -> DataFrame:
    """(title, item) of pages (page_id, title) and page properties (page_id, item); titles go through their redirects."""
    m = pages.select("page_id", "title").join(props.select("page_id", "item"), "page_id").select("title", "item")
    return resolve(m, redirect, "title").dropna().distinct()


def resolve_claims(claims: DataFrame, items: DataFrame, redirect: DataFrame) -> DataFrame:
    """Claims with tails redirected; those whose head or tail is no item are dropped."""
    c = resolve(claims, redirect, "tail")
    known = items.select("id").distinct()
    c = salted_join(c, known.withColumnRenamed("id", "tail"), ["tail"], "left_semi")
    return salted_join(c, known.withColumnRenamed("id", "head"), ["head"], "left_semi").select("head", "prop", "tail").distinct()


def resolve_units(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Literal claims with `unit` (an id, `-1` for none) as `unit_id`, -1 for none; an unknown unit stays null, its text as it is."""
    u = units.select(F.col("id").alias("unit"), F.col("lid").alias("unit_id")).groupBy("unit").agg(F.min("unit_id").alias("unit_id"))
    return claims.join(u, "unit", "left").withColumn("unit_id", F.when(F.col("unit") == "-1", F.lit(-1).cast("bigint")).otherwise(F.col("unit_id")))


def id_redirects(pages: DataFrame, redirects: DataFrame, items: DataFrame) -> DataFrame:
    """(dst, srcs) of items by the redirects of their pages: pages (page_id, id), redirects (page_id, dst id); dst must be an item."""
    r = redirects.join(pages, "page_id").where("id <> dst").join(items.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return r.groupBy("dst").agg(F.sort_array(F.collect_set("id")).alias("srcs"))


def overlap(a: DataFrame, b: DataFrame, redirect: DataFrame) -> DataFrame:
    """One row: sizes of both vocabularies (column v) and of their overlap, as they are and after redirects."""
    def count(x: DataFrame, name: str) -> DataFrame:
        return x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    a, b = a.select("v").dropna().distinct(), b.select("v").dropna().distinct()
    ra, rb = resolve(a, redirect, "v").distinct(), resolve(b, redirect, "v").distinct()
    parts = [count(a, "a"), count(b, "b"), count(a.join(b, "v", "left_semi"), "both"), count(ra.join(rb, "v", "left_semi"), "both_redirected")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
