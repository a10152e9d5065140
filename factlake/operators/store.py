"""Key-value operations on tables: gets, scans, statistics, merges and deletes, a batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators.skew import ranked


def multi_get(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys asked for; misses and null keys give nothing, repeated keys in `keys` don't repeat rows."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def prefix_get(table: DataFrame, **prefix) -> DataFrame:
    """Rows whose leading key columns have these values: pushed down to the scan."""
    for c, v in prefix.items():
        table = table.where(F.col(c) == F.lit(v))
    return table


def key_range(table: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with low <= key <= high."""
    return table.where(F.col(key).between(low, high))


def head(table: DataFrame, key: str, n: int, skip: int = 0) -> DataFrame:
    """The n rows after the first `skip` in order of a unique key (a top-n report, kept in one small heap a task)."""
    return table.orderBy(key).offset(skip).limit(n)


def random_rows(table: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, each as likely as any other (a sampling operator; one small heap a task)."""
    return table.orderBy(F.rand(seed)).limit(n)


def compact(table: DataFrame, path: str, by: list[str], files: int) -> None:
    """Rewrite a table as `files` files, laid out by range of `by` and sorted, so that scans of a key skip most of them."""
    table.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def exists(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys that the table holds."""
    return keys.join(table.select(key), key, "left_semi")


def value_sizes(table: DataFrame, keys: list[str]) -> DataFrame:
    """Number of values of every key: how selective it is."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_columns) of tables."""
    out = None
    for name, t in tables.items():
        row = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(t.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def describe(tables: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """(name, n_rows, n_columns, types, first, n_bytes): types of the columns, the first row by all columns as JSON, and
    the size where it is given. One small heap a task, nothing is sorted."""
    out = None
    for name, t in tables.items():
        types = ",".join(f"{c}:{k}" for c, k in t.dtypes)
        row = t.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct(*t.columns)).alias("m")).select(
            F.lit(name).alias("name"), "n_rows", F.lit(len(t.columns)).alias("n_columns"), F.lit(types).alias("types"), F.to_json("m").alias("first"), F.lit((sizes or {}).get(name)).cast("bigint").alias("n_bytes")
        )
        out = row if out is None else out.unionByName(row)
    return out


def items(table: DataFrame, key: str) -> DataFrame:
    """(key, value): every row as its key and a struct of the other columns."""
    return table.select(key, F.struct(*[c for c in table.columns if c != key]).alias("value"))


def prefix_delete(table: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key doesn't start with the prefix; rows with a null key stay."""
    return table.where(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def drop(spark: SparkSession, path: str) -> bool:
    """Delete the table at path; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def update_sets(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values, state) of old and new (key, value) rows merged: state is new, update, skip (nothing grows) or kept."""
    both = old.select(key, value, F.lit(1).alias("_o")).unionByName(new.select(key, value, F.lit(0).alias("_o"))).dropna()
    per = both.groupBy(key, value).agg(F.max("_o").alias("was"), F.min("_o").alias("is"))
    g = per.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"), F.max("was").alias("had"), F.min("was").alias("all_had"), F.min("is").alias("untouched"))
    state = F.when(F.col("had") == 0, "new").when(F.col("untouched") == 1, "kept").when(F.col("all_had") == 1, "skip").otherwise("update")
    return g.select(key, "values", state.alias("state"))


def merge_set(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Union of the value sets of each key: distinct (key, value) rows; nulls are left out."""
    return old.select(key, value).unionByName(new.select(key, value)).dropna().distinct()


def merge_counter(old: DataFrame, new: DataFrame, key: str, n: str) -> DataFrame:
    """Sum of the counters of each key; null counters count 0."""
    both = old.select(key, n).unionByName(new.select(key, n)).where(F.col(key).isNotNull())
    return both.groupBy(key).agg(F.sum(F.coalesce(F.col(n), F.lit(0))).cast("bigint").alias(n))


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose (leading) key is not among `keys`; rows with a null key stay."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def put(table: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows replace those with the same key."""
    return delete_keys(table, rows, on).unionByName(rows)


def last_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """One value a key: that of the row that comes last in `order` (null orders first)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def group_set(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted set of the values of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def positions(table: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows at positions low (from 0) up to, not including, high in the order of a unique key."""
    return ranked(table, [], [F.col(key)], "_n").where(F.col("_n").between(low + 1, high)).drop("_n")


def posting_set(rows: DataFrame, where: Column, item: str) -> DataFrame:
    return rows.where(where).select(item).where(F.col(item).isNotNull()).distinct()
