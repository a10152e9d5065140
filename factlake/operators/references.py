"""References to records that do not exist.

Composite keys with partial nulls: references are grouped by their null mask, and each mask is anti-joined on its
non-null columns, under a declared match rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.skew import SHARE, salted_join

MATCH = ("simple", "partial", "full")


def null_mask(keys: list[str]):
    """Bit i is set where keys[i] is null."""
    mask = F.lit(0)
    for i, k in enumerate(keys):
        mask = mask + F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def orphan_references(refs: DataFrame, targets: DataFrame, keys: list[str], at: str, created: str, deleted: str, match: str = "partial") -> DataFrame:
    """The rows of `refs` whose key no living row of `targets` has, with a column `reason`.

    reason: `missing` (no target with this key), `late` (targets exist, all that live longer than `at` were created
    after it), `deleted` (all were deleted at or before `at`), `partial_null` (only for match='full').

    match, as SQL declares it for foreign keys: `simple`: a key with any null is no reference; `partial`: the non-null
    columns must be found; `full`: either all columns are null (no reference) or none, anything else is an orphan.
    A key that is null throughout is never a reference. A null `at` makes no reference late or deleted; a null
    `created` means always there, a null `deleted` never deleted. Targets may be repeated; references are kept one by
    one, repeated ones too. Empty inputs give an empty result (empty targets: every reference is missing). Other
    columns of refs stay as they are, those of targets are left out, so names can't clash.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    k = len(keys)
    full = (1 << k) - 1
    life = targets.select(*keys, F.col(created).alias("_c"), F.col(deleted).alias("_d"))
    masked = refs.withColumn("_mask", null_mask(keys))
    # Nulls don't change a hash, so that of all key columns is that of the mask's own.
    counts = masked.groupBy("_mask", F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    totals = {r[0]: r[1] for r in counts.groupBy("_mask").agg(F.sum("n")).collect()}  # at most 2^k rows
    masks = sorted(totals)
    limit = F.lit(0.0)
    for m in masks:
        limit = F.when(F.col("_mask") == m, F.lit(totals[m] / SHARE)).otherwise(limit)
    hot: dict[int, list[int]] = {m: [] for m in masks}
    for m, h in counts.where((F.col("n") > limit) & (F.col("_mask") != full)).select("_mask", "h").collect():  # at most SHARE a mask
        hot[m].append(h)
    parts = []
    for m in masks:
        if m == full or (m and match == "simple"):
            continue
        some = masked.where(F.col("_mask") == m).drop("_mask")
        if m and match == "full":
            parts.append(some.withColumn("reason", F.lit("partial_null")))
            continue
        on = [c for i, c in enumerate(keys) if not m >> i & 1]
        there = life.where(" and ".join(f"`{c}` is not null" for c in on))
        # Lives of one key: what the test needs of them, merged before the shuffle. Of those never deleted the
        # earliest start; of the others the distinct (start, end), few for a key that names one record.
        lives = there.groupBy(*on).agg(
            F.min(F.when(F.col("_d").isNull(), F.coalesce("_c", F.lit("0001-01-01").cast("timestamp")))).alias("_open"),
            F.collect_set(F.when(F.col("_d").isNotNull(), F.struct(F.coalesce("_c", F.lit("0001-01-01").cast("timestamp")).alias("c"), F.col("_d").alias("d")))).alias("_ended"),
        )
        joined = salted_join(some, lives, on, "left", hot[m])
        t = F.col(at)
        alive = F.coalesce(F.col("_open") <= t, F.lit(False)) | F.exists("_ended", lambda x: (x["c"] <= t) & (x["d"] > t))
        later = (F.col("_open") > t) | F.exists("_ended", lambda x: (x["c"] > t) & (x["d"] > t))
        reason = F.when(F.col("_ended").isNull(), "missing").when(t.isNull() | alive, None).when(F.coalesce(later, F.lit(False)), "late").otherwise("deleted")
        parts.append(joined.withColumn("reason", reason).where("reason is not null").drop("_open", "_ended"))
    if not parts:
        return refs.withColumn("reason", F.lit(None).cast("string")).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_report(orphans: DataFrame, at: str, by: list[str]) -> DataFrame:
    """Orphans per table, month of `at` (`2021-07`, null where `at` is null) and reason."""
    return orphans.groupBy(*by, F.date_format(at, "yyyy-MM").alias("period"), "reason").agg(F.count(F.lit(1)).alias("n_refs"))
