"""Deeply nested records to flat tables by Merkle subtree identities.

A record is taken apart as a tree of Parts says: which members hold child objects, under keys, in arrays or alone, and
how deep. Every object gets a hash made bottom-up from its own members in canonical form and from the hashes, keys and
ordinals of its children, so equal subtrees have equal hashes whatever the order of members or the spacing. Objects are
stored once per hash; a bridge row per occurrence ties a child to its line, its parent object and its keys and ordinals
in the arrays as delivered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.session import cut
from factlake.sources.entity_json import canonical, read_entity

#: Hashes a task remembers of the objects it has written; beyond this number it forgets them all.
SEEN = 200_000


@dataclass(frozen=True)
class Part:
    """Child objects of a record: the member that holds them, their kind, and how they are held.

    keyed: the member is an object whose members are the entries; many: entries are arrays of objects (one bare object is
    an array of one); value: path of the member that must be there for the object to have a value, () if it always has.
    """

    name: str
    child: str
    keyed: bool = False
    many: bool = False
    value: tuple[str, ...] = ()
    parts: tuple[Part, ...] = ()
    names: frozenset = field(default=frozenset(), init=False)

    def __post_init__(self):
        object.__setattr__(self, "names", frozenset(p.name for p in self.parts))

    def valued(self, obj: dict) -> bool:
        for x in self.value:
            obj = obj.get(x) if isinstance(obj, dict) else None
        return obj is not None


_DATA = (Part("datavalue", "datavalue"),)
#: How entities of the dump are nested.
ENTITY = Part(
    "", "entity",
    parts=(
        Part("labels", "label", keyed=True, value=("value",)),
        Part("descriptions", "description", keyed=True, value=("value",)),
        Part("aliases", "alias", keyed=True, many=True, value=("value",)),
        Part("sitelinks", "sitelink", keyed=True, value=("title",)),
        Part("claims", "claim", keyed=True, many=True, value=("mainsnak", "datavalue"), parts=(
            Part("mainsnak", "mainsnak", value=("datavalue",), parts=_DATA),
            Part("qualifiers", "qualifier", keyed=True, many=True, value=("datavalue",), parts=_DATA),
            Part("references", "reference", many=True, parts=(Part("snaks", "refsnak", keyed=True, many=True, value=("datavalue",), parts=_DATA),)),
        )),
    ),
)

_COLUMNS = [
    ("rec", pa.string()), ("line_no", pa.int64()), ("child", pa.string()), ("keys", pa.list_(pa.string())), ("ords", pa.list_(pa.int32())),
    ("hash", pa.binary()), ("parent", pa.binary()), ("live", pa.bool_()), ("has_value", pa.bool_()), ("body", pa.string()),
]
_ARROW = pa.schema(_COLUMNS)
SCHEMA = "rec string, line_no bigint, child string, keys array<string>, ords array<int>, hash binary, parent binary, live boolean, has_value boolean, body string"


def node_hash(kind: str, body: str, children: list[tuple] = ()) -> bytes:
    """128 bits of a node: its kind, its own members in canonical form and, for every child, member, key, ordinal and hash."""
    h = blake2b(f"{kind} {body}".encode(), digest_size=16)
    if children:  # members of an object may come in any order
        h.update(repr(sorted(children)).encode())
    return h.digest()


def _entries(part: Part, held, odd: list) -> Iterator[tuple[str, int, dict]]:
    """(key, ordinal, object); what is neither an object nor null goes to odd, so that it stays with the parent."""
    if part.keyed:
        if not isinstance(held, dict):
            if held:
                odd.append(held)
            return
        groups = held.items()
    else:
        groups = (("", held),)
    for key, e in groups:
        if isinstance(e, dict):
            yield key, 0, e
        elif part.many and isinstance(e, list):
            for i, x in enumerate(e):
                if isinstance(x, dict):
                    yield key, i, x
                elif x is not None:
                    odd.append((key, i, x))
        elif e is not None and e != []:
            odd.append((key, e))


def walk(obj: dict, part: Part = ENTITY) -> Iterator[tuple[str, str, dict, bool]]:
    """(child, key, object, has_value) of the objects directly below a record."""
    for p in part.parts:
        if (held := obj.get(p.name)) is not None:
            for key, _, e in _entries(p, held, []):
                yield p.child, key, e, p.valued(e)


def identify(obj: dict, part: Part = ENTITY) -> tuple[bytes, str, list[tuple]]:
    """(hash, body, rows) of a record; rows (child, keys, ordinals, hash, parent's hash, live, has_value, body) of all below it.

    Hashes are made bottom-up. Absent, null and empty groups are the same. live: every object above has its value. Each
    occurrence has a row, whether it or those above it have a value or not.
    """
    rows: list[tuple] = []

    def node(obj: dict, part: Part, keys: tuple, ords: tuple, live: bool) -> tuple[bytes, str]:
        below: list[tuple] = []
        places: list[tuple] = []
        odd: list = []
        for p in part.parts:
            held = obj.get(p.name)
            if held is None:
                continue
            for key, i, e in _entries(p, held, odd):
                has = p.valued(e)
                ks, os = (*keys, key), (*ords, i)
                h, body = node(e, p, ks, os, live and has)
                places.append((p.child, key, i, h))
                below.append((p.child, ks, os, h, has, body))
        own = {x: v for x, v in obj.items() if x not in part.names} if part.parts else obj
        if odd:
            own = {**own, "\0odd": odd}
        body = canonical(own)
        h = node_hash(part.child, body, places)
        for child, ks, os, ch, has, b in below:
            rows.append((child, ks, os, ch, h, live, has, b))
        return h, body

    return (*node(obj, part, (), (), True), rows)


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        rows: list[tuple] = []
        for no, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            entity, reason = read_entity(raw)
            if entity is None or reason or entity["id"][0] not in "QqPp":
                continue
            root, body, below = identify(entity)
            below.append(("entity", (entity["id"],), (0,), root, None, True, True, body))
            for child, keys, ords, h, parent, live, has, b in below:
                rows.append(("b", no, child, keys, ords, h, parent, live, None, None))
                if h not in seen:
                    seen.add(h)
                    rows.append(("o", None, child, None, None, h, None, None, has, b))
            if len(seen) > SEEN:
                seen.clear()
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(_COLUMNS)
    try:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, _COLUMNS)], schema=_ARROW)
    except UnicodeEncodeError:  # keys with half a surrogate pair, which no UTF-8 text can hold
        keys = _COLUMNS.index(("keys", pa.list_(pa.string())))
        return _batch([(*r[:keys], r[keys] and tuple(k.encode("utf-8", "replace").decode() for k in r[keys]), *r[keys + 1 :]) for r in rows])


def shred(lines: DataFrame, line_no: str = "line_no", raw: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """(bridge, objects) of the lines that load and whose id starts with Q or P.

    bridge: (line_no, child, keys, ords, hash, parent, live), one row per occurrence of an object, repeated lines count
    each; keys and ords have an entry a level. objects: (child, hash, has_value, body), once per distinct object; body
    holds the members that are no objects of their own. Lines are read and hashed once; what comes out is written to the
    shared folder. Null, blank and broken lines give nothing, as do absent, null and empty groups. Equal lines and equal
    subtrees of different lines share their objects. Other columns are ignored.
    """
    rows = cut(lines.select(line_no, raw).mapInArrow(_shred, SCHEMA))
    bridge = rows.where("rec = 'b'").drop("rec", "has_value", "body")
    objects = rows.where("rec = 'o'").groupBy("child", "hash").agg(F.first("has_value").alias("has_value"), F.first("body").alias("body"))
    return bridge, objects


def children(bridge: DataFrame, objects: DataFrame) -> DataFrame:
    """The bridge rows below the records whose object has a value, as all above it have, with the object's canonical text."""
    return bridge.where("child <> 'entity' and live").join(objects.where("has_value"), ["child", "hash"])
