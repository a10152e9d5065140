"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factlake.session import cut

#: A key is hot if it holds more than one in SHARE rows; so there are at most SHARE hot keys at any size of input.
SHARE = 200
#: Parts into which the rows of a hot key are split.
SALTS = 32


def hot_hashes(df: DataFrame, keys: list[str], share: int = SHARE) -> list[int]:
    """Hashes of the keys that hold more than 1/share of the rows with a key. At most `share` numbers reach the driver."""
    counts = df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0).groupBy(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()  # the sum of all, while the largest are picked
    top = counts.observe(seen, F.sum("n").alias("total")).orderBy(F.desc("n")).limit(share).collect()
    return [h for h, n in top if n > (seen.get["total"] or 0) / share]


def slots(spark: SparkSession, n: int) -> list[int]:
    """n numbers that repartition(n, number) puts into n different partitions: one task a number."""
    rows = spark.range(20 * n * (n.bit_length() + 1), numPartitions=1).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("part")).agg(F.min("i").alias("i")).collect()
    return sorted(r["i"] for r in rows) if len(rows) == n else list(range(n))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", hot: list[int] | None = None, salts: int = SALTS) -> DataFrame:
    """left JOIN right USING (keys), with the left rows of hot keys spread over `salts` tasks.

    right holds few rows a key (it is repeated `salts` times for the hot keys only). Rows of left with a null key, which
    find no partner, are spread too. The salt is a hash of the whole row, so that a task run again salts alike; only rows
    that are equal in every column stay together. how: inner, left, left_semi or left_anti.
    """
    if hot is None:
        hot = hot_hashes(left, keys)
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    no_key = F.col(keys[0]).isNull()
    for k in keys[1:]:
        no_key = no_key | F.col(k).isNull()
    row = [c for c, kind in left.dtypes if "map<" not in kind]
    left = left.withColumn("_salt", F.when(is_hot | no_key, F.pmod(F.xxhash64(F.lit(7), *row), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the position (from 1) of each row in its group, in an order without ties, however large a group is.

    Rows are laid out by range of (group, order) and written once; a row's position is its place in its part plus the
    rows of the group in earlier parts. With by=[] the whole table is one group.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    cond = [*by, "_part"]
    if by:  # null groups are groups too
        starts = starts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_gp"), "_start")
        test = F.col("_part") == F.col("_gp")
        for i, c in enumerate(by):
            test = test & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        out = local.join(starts, test).drop("_gp", *[f"_g{i}" for i in range(len(by))])
    else:
        out = local.join(starts, cond)
    return out.withColumn(name, F.col("_r") + F.col("_start")).drop("_r", "_start", "_part")
