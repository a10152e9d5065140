from datetime import datetime as D

import pytest
from conftest import rows

from factlake.operators.references import orphan_references, orphan_report

KEYS = ["ns", "title"]
T1, T2, T3 = D(2021, 1, 5), D(2021, 6, 5), D(2022, 1, 5)


def run(spark, refs, targets, match="partial"):
    r = spark.createDataFrame(refs, "row_id int, ns int, title string, t timestamp, created timestamp, _x int")
    t = spark.createDataFrame(targets, "ns int, title string, created timestamp, deleted timestamp, row_id int, t int")
    return orphan_references(r, t, KEYS, "t", "created", "deleted", match)


TARGETS = [(0, "A", T1, None, 1, 1), (0, "A", T1, None, 2, 2), (0, "B", T1, T2, 1, 1), (1, "C", T2, None, 1, 1)]


def test_reasons(spark):
    refs = [(1, 0, "A", T2, None, 1), (2, 0, "B", T1, None, 1), (3, 0, "B", T2, None, 1), (4, 0, "B", T3, None, 1), (5, 1, "C", T1, None, 1), (6, 0, "C", T3, None, 1), (7, 0, "A", T1, None, 1), (8, 0, "A", None, None, 1)]
    out = run(spark, refs + refs[:1] + refs[5:6], TARGETS)
    assert rows(out.select("row_id", "reason")) == [(3, "deleted"), (4, "deleted"), (5, "late"), (6, "missing"), (6, "missing")]
    assert rows(orphan_report(out, "t", ["ns"])) == [(0, "2021-06", "deleted", 1), (0, "2022-01", "deleted", 1), (0, "2022-01", "missing", 2), (1, "2021-01", "late", 1)]


@pytest.mark.parametrize(("match", "want"), [("simple", []), ("partial", [(1, "missing"), (3, "missing")]), ("full", [(1, "partial_null"), (2, "partial_null"), (3, "partial_null")])])
def test_masks(spark, match, want):
    refs = [(1, None, "Z", T3, None, 1), (2, 1, None, T3, None, 1), (3, 7, None, T3, None, 1), (4, None, None, T3, None, 1)]
    assert rows(run(spark, refs, TARGETS, match).select("row_id", "reason")) == want


def test_empty(spark):
    assert rows(run(spark, [], TARGETS)) == []
    assert rows(run(spark, [(1, 0, "A", T1, None, 1)], []).select("row_id", "reason")) == [(1, "missing")]
    with pytest.raises(ValueError):
        run(spark, [], [], "some")


def test_hot_key(spark):
    refs = [(i, 0, "A" if i % 2 else f"x{i}", T2, None, 1) for i in range(12_000)]
    assert run(spark, refs, TARGETS).count() == 6_000
