"""Typed claims, labels and links of entity dumps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factlake.operators.nested import walk
from factlake.sources.entity_json import canonical, read_entity

_SCHEMA = pa.schema([("id", pa.string()), ("part", pa.string()), ("k", pa.string()), ("dtype", pa.string()), ("value", pa.string()), ("unit", pa.string())])


def typed(datavalue: dict) -> tuple[str, str, str | None]:
    """(dtype, value, unit) of a data value.

    entity: its id; time: without leading + and midnight; quantity: the amount without +, and the unit's id (`-1` if it has
    none); monolingual text and strings: the text; anything else: its JSON.
    """
    kind, v = datavalue.get("type"), datavalue.get("value")
    if kind == "wikibase-entityid" and isinstance(v, dict):
        number = v.get("id") or (f"Q{v['numeric-id']}" if v.get("numeric-id") is not None else None)
        return ("entity", str(number), None) if number else ("other", canonical(v), None)
    if kind == "time" and isinstance(v, dict) and isinstance(v.get("time"), str):
        return "time", re.sub(r"T00:00:00Z$", "", v["time"].removeprefix("+")), None
    if kind == "quantity" and isinstance(v, dict):
        unit = str(v.get("unit", "1"))
        return "quantity", str(v.get("amount")).removeprefix("+"), "-1" if unit == "1" else unit.rsplit("/", 1)[-1]
    if kind == "monolingualtext" and isinstance(v, dict):
        return "string", str(v.get("text")), None
    return ("string", v, None) if isinstance(v, str) else ("other", canonical(v), None)


def entity_facts(entity: dict) -> Iterator[tuple]:
    """(part, k, dtype, value, unit): the main label (English, else the id), labels, descriptions, aliases, sitelinks, claims."""
    en = entity.get("labels")
    en = en.get("en") if isinstance(en, dict) else None
    yield "main", "", None, en["value"] if isinstance(en, dict) and en.get("value") else entity["id"], None
    for child, k, obj, valued in walk(entity):
        if not valued:
            continue
        if child in ("label", "description", "alias"):
            yield child, k, None, str(obj["value"]), None
        elif child == "sitelink":
            yield child, k, None, str(obj["title"]), None
        elif child == "claim" and isinstance(obj["mainsnak"]["datavalue"], dict):
            yield "claim", k, *typed(obj["mainsnak"]["datavalue"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for raw in b.column(0).to_pylist():
            entity, reason = read_entity(raw)
            if entity is not None and not reason and entity["id"][0] in "QqPp":
                rows += [(entity["id"].upper(), *f) for f in entity_facts(entity)]
        cols = list(zip(*rows)) or [[]] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _SCHEMA.types)], schema=_SCHEMA)


def read_entities(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """(id, part, k, dtype, value, unit) of the lines that load and are items or properties; repeated ones count once."""
    return lines.select(raw).mapInArrow(_rows, "id string, part string, k string, dtype string, value string, unit string").distinct()
