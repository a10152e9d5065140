"""Lines of entity dumps (JSON array files, one entity a line): strict reading at any depth, and canonical JSON."""

from __future__ import annotations

import json
import re

_ID = re.compile(r"[QqPpLl][0-9]+", re.ASCII)
#: Digits up to which a whole number is read as one; longer ones are kept as they are written.
_DIGITS = 4000
_MARK = re.compile(
    r"""[ \t\n\r]*(?:(?P<sign>[{}\[\],:])
    |(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")
    |(?P<other>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))""",
    re.VERBOSE,
)
_END = re.compile(r"[ \t\n\r]*\Z")


class LongNumber:
    """A whole number with more digits than are converted; equal if written alike."""

    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other) -> bool:
        return isinstance(other, LongNumber) and self.text == other.text

    def __hash__(self) -> int:
        return hash(self.text)

    def __str__(self) -> str:
        return self.text


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _whole(text: str):
    return int(text) if len(text) < _DIGITS else LongNumber(text)


def _number_as_text(x):
    if isinstance(x, LongNumber):
        return {"\0number": x.text}
    raise TypeError(type(x).__name__)


def _encoder():
    """JSONEncoder(...).encode makes a new encoder of its own for every value; this one is made once."""
    make = json.encoder.c_make_encoder
    if make is None:
        return json.JSONEncoder(sort_keys=True, separators=(",", ":"), default=_number_as_text).encode
    run = make(None, _number_as_text, json.encoder.encode_basestring_ascii, None, ":", ",", True, False, True)
    return lambda x: "".join(run(x, 0))


_encode = _encoder()


def canonical(x) -> str:
    """JSON with members by name and no spaces, at any depth."""
    try:
        return _encode(x)
    except RecursionError:
        return _canonical_deep(x)


def _canonical_deep(x) -> str:
    """canonical() with a stack of its own."""
    out: list[str] = []
    todo: list = [(x, None)]
    while todo:
        x, sign = todo.pop()
        if sign is not None:
            out.append(sign)
        elif isinstance(x, dict) and x:
            out.append("{")
            todo.append((None, "}"))
            for i, (k, v) in enumerate(sorted(x.items(), reverse=True)):
                todo += [(v, None), (None, ("" if i == len(x) - 1 else ",") + _encode(k) + ":")]
        elif isinstance(x, list) and x:
            out.append("[")
            todo.append((None, "]"))
            for i, v in enumerate(reversed(x)):
                todo.append((v, None))
                if i < len(x) - 1:
                    todo.append((None, ","))
        else:
            out.append(_encode(x))
    return "".join(out)


def parse(text: str):
    """The value of a JSON text at any depth; ValueError if it is not exactly one."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=_whole)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """parse() with a stack of its own: a container waits for `value`, `name`, `colon` or `next`."""
    stack: list = []
    at, wait, name, result = 0, "value", None, None
    first = False  # directly after the opening sign: the container may close at once
    while True:
        m = _MARK.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at = m.end()
        sign = m["sign"]
        if wait == "colon":
            if sign != ":":
                raise ValueError("no colon")
            wait, first = "value", False
            continue
        if wait == "next" and sign == ",":
            wait, first = ("name" if isinstance(stack[-1][0], dict) else "value"), False
            continue
        closes = sign and sign in "}]" and stack and (wait == "next" or first) and sign == ("}" if isinstance(stack[-1][0], dict) else "]")
        if closes:
            result, name = stack.pop()
        elif wait == "name":
            if not m["text"]:
                raise ValueError("no name")
            name, wait = json.loads(m["text"]), "colon"
            continue
        elif wait != "value" or sign and sign not in "{[":
            raise ValueError("out of place")
        elif sign:
            stack.append(({} if sign == "{" else [], name))
            wait, first = ("name" if sign == "{" else "value"), True
            continue
        else:
            result = json.loads(m["text"] or m["other"], parse_int=_whole)
        if not stack:
            if not _END.match(text, at):
                raise ValueError("more than one value")
            return result
        box = stack[-1][0]
        if isinstance(box, dict):
            box[name] = result
        else:
            box.append(result)
        wait, first = "next", False


def read_entity(raw: str | None):
    """(entity, reason): (None, None) for lines that hold no record (null, blank, a bracket), else the object or why not.

    reason is `json` if the line, without outer spaces and at most one final comma, is not exactly one JSON object, and
    `id` if its id is absent or not a string of Q, P or L (either case) and digits. Records may be nested at any depth.
    """
    if raw is None:
        return None, None
    line = raw.strip()
    if line in ("", "[", "]"):
        return None, None
    if line.endswith(","):
        line = line[:-1].rstrip()
    try:
        entity = parse(line)
    except ValueError:
        return None, "json"
    if not isinstance(entity, dict):
        return None, "json"
    eid = entity.get("id")
    if not isinstance(eid, str) or not _ID.fullmatch(eid):
        return entity, "id"
    return entity, None
