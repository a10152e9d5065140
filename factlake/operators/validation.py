"""Rows that fail to parse.

Parsed input of any kind is tuples of cells. They are exploded into (row, column, value), joined with a small rule table,
validated by built-in expressions, and the errors of a row are aggregated; the valid rows are the anti-join with these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.session import cut
from factlake.sources.entity_json import canonical, read_entity
from factlake.sources.sql_dump import CELLS_SCHEMA

#: Fixed values: (table, column number, column, rule, rule holds only if that column ..., ... has this value).
RULES = [
    ("page", 0, "page_id", "positive", None, None),
    ("page", 1, "page_namespace", "digits", None, None),
    ("page", 2, "page_title", "text", None, None),
    ("page", 3, "page_is_redirect", "flag", None, None),
    ("page", 4, "page_len", "digits", None, None),
    ("page", 5, "page_touched", "moment", None, None),
    ("redirect", 0, "rd_from", "positive", None, None),
    ("redirect", 1, "rd_namespace", "digits", None, None),
    ("redirect", 2, "rd_title", "text", None, None),
    ("redirect", 3, "rd_interwiki", "any", None, None),
    ("redirect", 4, "rd_fragment", "any", None, None),
    ("page_props", 0, "pp_page", "positive", None, None),
    ("page_props", 1, "pp_propname", "text", None, None),
    ("page_props", 2, "pp_value", "item", 1, "wikibase_item"),
    ("page_props", 3, "pp_sortkey", "any", None, None),
    ("entity_dump", 0, "id", "entity_id", None, None),
]
RULE_SCHEMA = "tbl string, col_no int, name string, rule string, if_col int, if_value string"
#: The reason that a broken rule is reported as, where it isn't `value`.
REASONS = {"entity_id": "id"}


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def holds(rule: Column, value: Column, quoted: Column) -> Column:
    """Whether a cell obeys its rule; null values and unknown rules are handled, the result is never null."""
    plain = ~quoted
    test = (
        F.when(rule == "positive", plain & value.rlike("^[0-9]+$") & value.rlike("[1-9]"))
        .when(rule == "digits", plain & value.rlike("^[0-9]+$"))
        .when(rule == "flag", plain & value.isin("0", "1"))
        .when(rule == "text", value != "")
        .when(rule == "moment", value.rlike("^[0-9]{14}$") & F.try_to_timestamp(F.when(value.rlike("^[0-9]{14}$"), value), F.lit("yyyyMMddHHmmss")).isNotNull())
        .when(rule == "item", value.rlike("^[Qq][0-9]+$"))
        .when(rule == "entity_id", quoted & value.rlike("^[QqPpLl][0-9]+$"))
        .otherwise(F.lit(True))
    )
    return F.coalesce(test, F.lit(False))


def rejected(tuples: DataFrame, rules: DataFrame) -> DataFrame:
    """(line_no, tuple_no, reason, fields) of the parsed tuples that are no rows: their fault, `columns`, or a broken rule.

    tuples: (line_no, tbl, fault, tuple_no, cells), as sql_tuples and entity_tuples give them. Cells are exploded in one
    pass over the parsed input and joined with the rules; only broken ones are shuffled and aggregated. fields lists the
    columns whose value breaks its rule. Tables without rules are not judged. rules is a small table and is broadcast:
    it grows with the schema, not with the data.
    """
    width = rules.groupBy("tbl").agg(F.count(F.lit(1)).alias("width"))
    shape = F.coalesce("fault", F.when(F.size("cells") != F.col("width"), F.lit("columns")))
    sized = tuples.join(F.broadcast(width), "tbl").withColumn("shape", shape)
    no_cell = F.expr("array(cast(null as struct<value:string,quoted:boolean>))")
    cells = sized.select("line_no", "tuple_no", "tbl", "shape", "cells", F.posexplode(F.when(F.col("shape").isNull(), F.col("cells")).otherwise(no_cell)).alias("col_no", "cell"))
    judged = cells.join(F.broadcast(rules), ["tbl", "col_no"])
    applies = F.col("if_col").isNull() | F.coalesce(F.get("cells", F.col("if_col"))["value"] == F.col("if_value"), F.lit(False))
    broken = F.col("shape").isNull() & applies & ~holds(F.col("rule"), F.col("cell.value"), F.col("cell.quoted"))
    reason = F.lit("value")
    for rule, name in REASONS.items():
        reason = F.when(F.col("rule") == rule, F.lit(name)).otherwise(reason)
    errors = judged.where(F.col("shape").isNotNull() | broken).select("line_no", "tuple_no", F.coalesce("shape", reason).alias("reason"), F.when(broken, F.col("name")).alias("name"))
    return errors.groupBy("line_no", "tuple_no").agg(F.min("reason").alias("reason"), F.sort_array(F.collect_list("name")).alias("fields"))


def _entity_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        no, faults, cells = [], [], []
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            entity, reason = read_entity(raw)
            if entity is None and reason is None:
                continue
            eid = entity.get("id") if entity else None
            no.append(n)
            faults.append("json" if reason == "json" else None)
            cells.append([{"value": eid if isinstance(eid, str) else None if eid is None else canonical(eid), "quoted": isinstance(eid, str)}])
        n = len(no)
        try:
            data = pa.array(cells, _CELLS)
        except UnicodeEncodeError:  # ids with half a surrogate pair, which are no ids
            data = pa.array([[{**c[0], "value": (c[0]["value"] or "").encode("utf-8", "replace").decode()}] for c in cells], _CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(["entity_dump"] * n, pa.string()), pa.array(faults, pa.string()), pa.array([0] * n, pa.int32()), data], names=["line_no", "tbl", "fault", "tuple_no", "cells"])


_CELLS = pa.list_(pa.struct([("value", pa.string()), ("quoted", pa.bool_())]))


def entity_tuples(lines: DataFrame, line_no: str = "line_no", raw: str = "raw_line") -> DataFrame:
    """One row per line of an entity dump that holds a record: its id as the one cell, or the fault `json`.

    Null and blank lines and brackets hold no record.
    """
    return lines.select(line_no, raw).mapInArrow(_entity_cells, CELLS_SCHEMA)


def load(tuples: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) tuples; valid ones have every cell by name in a map. Both cover all tuples of tables with rules.

    Input is parsed once and written to the shared folder; the valid rows are the anti-join with the rejected ones.
    """
    parsed = cut(tuples)
    bad = rejected(parsed, rules)
    names = rules.groupBy("tbl").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "name"))), lambda x: x["name"]).alias("names"))
    good = parsed.join(bad.select("line_no", "tuple_no"), ["line_no", "tuple_no"], "left_anti").join(F.broadcast(names), "tbl")
    return good.select("line_no", "tuple_no", "tbl", F.map_from_arrays("names", F.transform("cells", lambda c: c["value"])).alias("row")), bad
