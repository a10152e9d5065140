from datetime import datetime as D

import pytest
from conftest import rows

from factlake.operators import widen as W


@pytest.mark.parametrize(
    ("tail", "want"),
    [
        (None, None), ("", None), ("  ", None),
        ("Mount_X", ("entity", "Mount X")), ("<http://kb.example/resource/mount_%C3%A9>", ("entity", "Mount é")), ("http://kb.example/resource/a_(b)", ("entity", "A (b)")),
        ('"014"^^xsd:integer', ("quantity", "14")), ('"+14"^^<xsd:int>', ("quantity", "14")), ('"1.40E1"^^xsd:double', ("quantity", "14")), ('"14.0"^^xsd:decimal', ("quantity", "14")), ('"-0.50"^^xsd:float', ("quantity", "-5e-1")),
        ('"14.0"^^xsd:integer', ("string", "14.0")), ('"1.2.3"^^xsd:double', ("string", "1.2.3")), ('"NaN"^^xsd:double', ("string", "NaN")), ('"12,000"^^xsd:decimal', ("string", "12,000")), ('"0"^^http://www.w3.org/2001/XMLSchema#integer', ("quantity", "0")),
        ('"2020-02-29"^^xsd:date', ("time", "2020-02-29")), ('"2019-02-29"^^xsd:date', ("string", "2019-02-29")), ('"1900-02-29"^^xsd:date', ("string", "1900-02-29")), ('"2020-01-01T24:00:00"^^xsd:dateTime', ("string", "2020-01-01T24:00:00")), ('"2020-01-01T23:59:59Z"^^xsd:dateTime', ("time", "2020-01-01T23:59:59Z")), ('"1746"^^xsd:gYear', ("time", "1746")), ('"46"^^xsd:gYear', ("string", "46")),
        ('"true"^^xsd:boolean', ("string", "true")), ('"x"@en', ("string", "x")), ('"x"^^xsd:string', ("string", "x")), ('"a \\"b\\" \\\\ \\u00e9\\U0001F600"@fr', ("string", 'a "b" \\ é😀')), ('"\\ud83d\\ude00"', ("string", "😀")), ('"\\ud83d"', ("string", "\\ud83d")), ('""', ("string", "")),
    ],
)
def test_typed_value(tail, want):
    assert W.typed_value(tail) == want


ROWS = [
    (1, "<http://kb.example/resource/mount_X>", "Alias", '"a"@en', D(2021, 1, 1)), (2, "Mount_X", "http://kb.example/ontology/alias", '"a"', D(2021, 2, 1)), (3, "mount_X", "<http://kb.example/property/alias>", '"b"', None),
    (4, "Mount X", "size", '"1"^^xsd:int', D(2021, 1, 1)), (5, "Mount X", "size", '"01"^^xsd:int', D(2021, 1, 1)), (6, "Mount X", "size", '"big"', D(2020, 1, 1)), (7, None, "p", "x", None), (8, "h", None, "x", None), (9, "h", "p", None, None), (9, "h", "p", "", None), (4, "Mount X", "size", '"1"^^xsd:int', D(2021, 1, 1)),
]


def test_cells(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "row_id long, head string, prop string, tail string, loaded_at timestamp, value string, at int")
    c = W.compact(W.sparse_deltas(df))
    assert rows(W.filled_cells(c)) == [("Mount X", "alias", "string", 2), ("Mount X", "size", "quantity", 1), ("Mount X", "size", "string", 1)]
    assert rows(W.compact(W.sparse_deltas(df), "latest").select("prop", "dtype", "value")) == [("alias", "string", "a"), ("size", "quantity", "1")]
    w = W.wide(c).collect()
    assert len(w) == 1 and w[0].quantity == {"size": [1.0]} and w[0].string == {"alias": ["a", "b"], "size": ["big"]} and w[0].entity == {}
    assert rows(W.filled_cells(W.compact(W.sparse_deltas(df.where("false"))))) == []


def test_deltas_are_wide(spark):
    """One row per head and flush, with the filled cells only, in order, each with its version."""
    df = spark.createDataFrame(ROWS, "row_id long, head string, prop string, tail string, loaded_at timestamp").coalesce(1)
    d = W.sparse_deltas(df).collect()
    assert [r.head for r in d] == ["Mount X"]
    assert [(c.prop, c.dtype, c.value, c.row_id) for c in d[0].cells] == [("alias", "string", "a", 2), ("alias", "string", "b", 3), ("size", "quantity", "1", 5), ("size", "string", "big", 6)]


@pytest.mark.parametrize(("a", "b"), [("1e3", "1000"), ("+001.50", "1.5"), (".5", "0.5"), ("-0.0", "0"), ("1e9999999", "10e9999998"), ("1e-2", ".01")])
def test_same_number(a, b):
    assert W.number_key(a) == W.number_key(b)


def test_batches_in_any_order(spark):
    """Runs made of two batches, either first, compact to what one batch gives."""
    df = spark.createDataFrame(ROWS, "row_id long, head string, prop string, tail string, loaded_at timestamp")
    a, b = W.sparse_deltas(df.where("row_id % 2 = 0")), W.sparse_deltas(df.where("row_id % 2 = 1"))
    assert rows(W.compact(a.union(b))) == rows(W.compact(b.union(a))) == rows(W.compact(W.sparse_deltas(df)))


def test_long_value(spark):
    df = spark.createDataFrame([(1, "h", "p", '"' + "x" * 500_000 + '"', None)] * 3, "row_id long, head string, prop string, tail string, loaded_at timestamp")
    assert rows(W.filled_cells(W.compact(W.sparse_deltas(df)))) == [("H", "p", "string", 1)]
