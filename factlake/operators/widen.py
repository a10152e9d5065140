"""Attribute-value rows to wide tables as log-structured upserts.

Each task turns its batches into sparse wide deltas: a row per entity with the cells that the batch fills and no others,
every cell with the version of its row (a memory table that is flushed, sorted, when it holds FLUSH cells). Runs are then
compacted: per cell, or per value of a cell where cells hold sets, the latest version stays. The wide table has one row
per entity and a typed column per type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells in a task's memory before they are flushed as a run.
FLUSH = 100_000
#: Datatypes of numbers without and with point and exponent, and of times.
WHOLE = {"integer", "int", "nonNegativeInteger"}
REAL = {"double", "decimal", "float"}
TIMES = {"date", "dateTime", "gYear"}
_LITERAL = re.compile(r'"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<?([^<>"\s]+)>?)?', re.DOTALL)
_INT = re.compile(r"[+-]?[0-9]+")
_NUM = re.compile(r"([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?)0*([0-9]*))?")
_DATE = re.compile(r"(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:Z|[+-][0-9]{2}:[0-9]{2})?")
_STAMP = re.compile(r"(-?[0-9]{4,}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?")
_YEAR = re.compile(r"-?[0-9]{4,}(?:Z|[+-][0-9]{2}:[0-9]{2})?")
_ESC = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
#: One-letter escapes of N-Triples.
_ONE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def local_name(term: str) -> str:
    """Last part of a URI without angle brackets; a short spelling stays as it is."""
    t = term.strip()
    if t.startswith("<") and t.endswith(">"):
        t = t[1:-1]
    return t.rstrip("/").rsplit("/", 1)[-1].rsplit("#", 1)[-1] if "://" in t else t


def plain_name(term: str) -> str:
    """As a plain title: percent-decoded, spaces for `_`, first letter capital."""
    t = unquote(local_name(term)).replace("_", " ").strip()
    return t[:1].upper() + t[1:]


def unescape(text: str) -> str:
    """Resolve the escapes of N-Triples; code points that don't exist stay as written."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[3] is not None:
            return _ONE.get(m[3], m[3])
        n = int(m[1] or m[2], 16)
        return m[0] if n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n)

    return _ESC.sub(one, re.sub(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})", lambda m: chr(0x10000 + (int(m[1], 16) - 0xD800) * 0x400 + int(m[2], 16) - 0xDC00), text))


def _in_calendar(kind: str, text: str) -> bool:
    if kind == "gYear":
        return bool(_YEAR.fullmatch(text))
    stamp = _STAMP.fullmatch(text) if kind == "dateTime" else None
    if kind == "dateTime" and not (stamp and int(stamp[2]) < 24 and int(stamp[3]) < 60 and int(stamp[4]) < 60):
        return False
    day = _DATE.fullmatch(stamp[1] if stamp else text)
    if not day:
        return False
    try:  # the calendar repeats every 400 years
        date(2000 + int(day[1]) % 400, int(day[2]), int(day[3]))
    except ValueError:
        return False
    return True


def number_key(text: str) -> str:
    """The same text for the same number: `+014` and `1.40E1` both give `14`. Any number of digits, exponents of 4,000."""
    sign, whole, part, only, exp_sign, exp = (x or "" for x in _NUM.fullmatch(text).groups())
    part = part or only
    digits = (whole + part).lstrip("0")
    if not digits:
        return "0"
    if len(exp) > 4_000:
        return f"{'-' * (sign == '-')}{digits}e{exp_sign}{exp}-{len(part)}"
    s = digits.rstrip("0")
    shift = int(exp_sign + (exp or "0")) - len(part) + len(digits) - len(s)
    return "-" * (sign == "-") + (s + "0" * shift if 0 <= shift <= 40 else f"{s}e{shift}")


def typed_value(tail: str | None) -> tuple[str, str] | None:
    """(dtype, value in the form in which values are compared), or None if the tail fills nothing (null, empty, blank)."""
    if tail is None or not tail.strip():
        return None
    m = _LITERAL.fullmatch(tail.strip())
    if not m:
        return "entity", plain_name(tail)
    text, dtype = unescape(m[1]), m[3]
    if dtype:
        dtype = re.split(r"[#:/]", dtype)[-1]
        if dtype in WHOLE and _INT.fullmatch(text) or dtype in REAL and _NUM.fullmatch(text):
            return "quantity", number_key(text)
        if dtype in TIMES and _in_calendar(dtype, text):
            return "time", text
    return "string", text


_CELL = pa.struct([("prop", pa.string()), ("dtype", pa.string()), ("value", pa.string()), ("at", pa.int64()), ("row_id", pa.int64())])
DELTA = "head string, cells array<struct<prop: string, dtype: string, value: string, at: bigint, row_id: bigint>>"


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory: dict[str, dict[tuple, tuple]] = {}
    filled = 0
    names: dict[str, str] = {}
    props: dict[str, str] = {}

    def flush() -> pa.RecordBatch:
        heads, ends, cells = sorted(memory), [0], []
        for h in heads:
            cells += [(*c, *v) for c, v in sorted(memory[h].items())]
            ends.append(len(cells))
        memory.clear()
        cols = list(zip(*cells)) or [[]] * 5
        flat = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _CELL)], fields=list(_CELL))
        return pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["head", "cells"])

    for batch in batches:
        at = batch.column(4).cast(pa.int64()).to_pylist()
        for head, prop, tail, row_id, t in zip(*(batch.column(i).to_pylist() for i in range(4)), at):
            value = typed_value(tail)
            if value is None or head is None or prop is None:
                continue
            if len(names) > FLUSH:
                names.clear()
            h = names.get(head)
            if h is None:
                h = names[head] = plain_name(head)
            p = props.get(prop)
            if p is None:
                if len(props) > FLUSH:
                    props.clear()
                p = local_name(prop)
                p = props[prop] = p[:1].lower() + p[1:]
            row = memory.get(h)
            if row is None:
                row = memory[h] = {}
            cell, version = (p, *value), (t if t is not None else -(1 << 62), row_id if row_id is not None else -1)
            was = row.get(cell)
            if was is None:
                filled += 1
            if was is None or was <= version:
                row[cell] = version
            if filled >= FLUSH:
                yield flush()
                filled = 0
    yield flush()


def sparse_deltas(triples: DataFrame) -> DataFrame:
    """(head, cells): sorted runs of sparse wide rows that `triples` (row_id, head, prop, tail, loaded_at) fills.

    cells: array of (prop, dtype, value, at, row_id), in order; a row holds the cells of one flush of one task, so a head has
    several. Repeated rows of a flush are merged at once, with the latest version (loaded_at, row_id). Null heads or props
    and null, empty or blank tails fill nothing. A null loaded_at is older than any other. Other columns are ignored.
    """
    t = triples.select("head", "prop", "tail", F.col("row_id").cast("bigint"), F.col("loaded_at").cast("timestamp_ntz"))
    return t.mapInArrow(_deltas, DELTA)


def compact(runs: DataFrame, keep: str = "all") -> DataFrame:
    """Merge runs to (head, prop, dtype, value, version), the latest version of each cell.

    keep='all': cells hold sets, and every different value of one stays with its latest version; 'latest': a cell
    (head, prop) holds one value, the newest (ties by type and value). Versions are merged before the shuffle, which is by
    the whole cell, so that a head with any share of the rows is spread.
    """
    cells = runs.select("head", F.inline("cells"))
    version = F.struct("at", "row_id")
    if keep == "all":
        return cells.groupBy("head", "prop", "dtype", "value").agg(F.max(version).alias("version"))
    newest = cells.groupBy("head", "prop").agg(F.max(F.struct(version.alias("version"), "dtype", "value")).alias("m"))
    return newest.select("head", "prop", "m.dtype", "m.value", "m.version")


def filled_cells(compacted: DataFrame) -> DataFrame:
    """(head, prop, dtype, n_values): one row per filled cell."""
    return compacted.groupBy("head", "prop", "dtype").agg(F.count(F.lit(1)).cast("int").alias("n_values"))


def wide(compacted: DataFrame) -> DataFrame:
    """One row per head with one typed map column a type: entity and string texts, quantity numbers, time as written."""
    cells = compacted.groupBy("head", "prop", "dtype").agg(F.sort_array(F.collect_set("value")).alias("vals"))
    of = lambda d: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("dtype") == d, F.struct("prop", "vals")))))
    w = cells.groupBy("head").agg(of("entity").alias("entity"), of("quantity").alias("q"), of("time").alias("time"), of("string").alias("string"))
    return w.select("head", "entity", F.transform_values("q", lambda _, v: F.transform(v, lambda x: x.try_cast("double"))).alias("quantity"), "time", "string")
