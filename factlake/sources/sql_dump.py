"""INSERT lines of MySQL dumps: strings in single quotes, backslash escapes, one or more tuples a line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HEAD = re.compile(r"\s*INSERT\s+INTO\s+`?(\w+)`?(?:\s*\([^)]*\))?\s+VALUES\s*", re.IGNORECASE)
_CELL = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|([^',()]*?))\s*([,)])", re.DOTALL)
_NEXT = re.compile(r"\s*(?:,\s*(?=\()|;?\s*$)", re.DOTALL)
#: What MySQL writes after a backslash for these characters.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)

CELLS_SCHEMA = "line_no bigint, tbl string, fault string, tuple_no int, cells array<struct<value:string,quoted:boolean>>"
_ARROW = pa.schema([("line_no", pa.int64()), ("tbl", pa.string()), ("fault", pa.string()), ("tuple_no", pa.int32()), ("cells", pa.list_(pa.struct([("value", pa.string()), ("quoted", pa.bool_())])))])


def parse_insert(line: str | None):
    """(table, tuples) of an INSERT line; (None, None) for any other line; (table, None) if its quoting is broken.

    A cell is (value, quoted); an unquoted NULL has the value None. Escapes are resolved in quoted values.
    """
    head = _HEAD.match(line) if line else None
    if not head:
        return None, None
    table, at, tuples = head[1].lower(), head.end(), []
    while at < len(line):
        if line[at] != "(":
            return table, None
        at, row = at + 1, []
        while True:
            m = _CELL.match(line, at)
            if not m:
                return table, None
            at = m.end()
            if m[1] is not None:
                v = m[1]
                row.append((_UNESCAPE.sub(lambda e: _ESCAPES.get(e[1], e[1]), v) if "\\" in v else v, True))
            else:
                row.append((None if m[2].upper() == "NULL" else m[2], False))
            if m[3] == ")":
                break
        tuples.append(row)
        m = _NEXT.match(line, at)
        if not m:
            return table, None
        at = m.end()
    return table, tuples


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for no, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table, tuples = parse_insert(raw)
            if table is None:
                continue
            rows = [("quoting", 0, None)] if tuples is None else [(None, i, [{"value": v, "quoted": q} for v, q in t]) for i, t in enumerate(tuples, 1)]
            for fault, i, cells in rows:
                for c, x in zip(cols, (no, table, fault, i, cells)):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)


def sql_tuples(lines: DataFrame, line_no: str = "line_no", raw: str = "raw_line") -> DataFrame:
    """One row per tuple of every INSERT line (line_no, tbl, fault, tuple_no from 1, cells).

    A line with broken quoting is one row with tuple_no 0, fault `quoting` and no cells. Lines that are no INSERT, null
    and empty ones give nothing; a line without tuples neither.
    """
    return lines.select(line_no, raw).mapInArrow(_parse, CELLS_SCHEMA)
