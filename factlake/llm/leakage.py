"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over seeds of the normalised test texts scans every document once. A seed is SEED words in a
row, taken at every STEP-th word of a passage, so every run of MIN_WORDS words holds a whole one; at a hit the match is
extended to both sides as far as text and passage agree. Stretches found are laid over the words of their item; offsets
are mapped back to the document as it was written.

Seeds instead of all windows keep the automaton under 40 bytes a character of test text. Tasks build it from the test
text itself, which is all that is sent to them, and keep it for as long as they work on the same test text.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.session import cut

#: A stretch has at least MIN_WORDS words in a row; all stretches together make up at least MIN_SHARE of the item's words.
MIN_WORDS, MIN_SHARE = 8, 0.25
#: Characters of test text in one automaton (at most 160 MB in a task). More test text is taken in further rounds, none is left out.
BLOCK_CHARS = 4_000_000
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|\[\[(?:[^\[\]|]*\|)?|\]\([^()\s]*\)|&(?:nbsp|amp|lt|gt|quot|#[0-9]+|#x[0-9A-Fa-f]+);", re.DOTALL)


class _Letters(dict):
    """Code point -> its letters and digits without case, width and accents; filled as characters turn up."""

    def __missing__(self, cp: int) -> str:
        self[cp] = out = "".join(c for c in unicodedata.normalize("NFKD", chr(cp).casefold()) if c.isalnum())
        return out


_LETTERS = _Letters()


def bare(text: str) -> str:
    """Letters and digits only: no case, accents, punctuation, spaces, markup."""
    return _MARKUP.sub("", text).translate(_LETTERS)


def bare_offsets(text: str) -> list[int]:
    """For every character of bare(text), the place in text it comes from."""
    out, at = [], 0
    for m in [*_MARKUP.finditer(text), None]:
        end = m.start() if m else len(text)
        for i in range(at, end):
            out += [i] * len(_LETTERS[ord(text[i])])
        at = m.end() if m else end
    return out


def words(text: str) -> list[str]:
    """Words by white space, in bare form; what is only punctuation or markup is no word."""
    return [w for w in (x.translate(_LETTERS) for x in _MARKUP.sub("", text).split()) if w]


class Seeds:
    """The automaton of some items (key, words joined by spaces), with what is needed to extend a hit."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        import ahocorasick

        self.min_words = min_words
        self.step = min_words // 2 + 1
        self.seed = min_words - self.step + 1
        self.keys: list[int] = []
        self.flat: list[str] = []
        self.starts: list[list[int]] = []
        index: dict[str, int] = {}
        self.places: list[list[tuple[int, int]]] = []
        for key, text in items:
            ws = text.split(" ") if text else []
            n, starts, at = len(self.keys), [0], 0
            for w in ws:
                starts.append(at := at + len(w))
            self.keys.append(key)
            self.flat.append("".join(ws))
            self.starts.append(starts)
            if len(ws) >= min_words:
                for i in range(0, len(ws) - self.seed + 1, self.step):
                    k = index.setdefault("".join(ws[i : i + self.seed]), len(index))
                    if k == len(self.places):
                        self.places.append([])
                    self.places[k].append((n, starts[i]))
        self.lengths = list(map(len, index))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, k in index.items():
            self.automaton.add_word(p, k)
        if index:
            self.automaton.make_automaton()

    def scan(self, text: str) -> dict[int, tuple[int, int, list[tuple[int, int]]]]:
        """item -> (its words, those that are covered, spans in the text as written). Stretches begin and end where words do."""
        if not self.lengths:
            return {}
        flat = bare(text)
        at: list[int] | None = None
        reached: dict[tuple[int, int], int] = {}
        covered: dict[int, set[int]] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, k in self.automaton.iter(flat):
            n = self.lengths[k]
            first = last - n + 1
            for item, there in self.places[k]:
                shift = first - there
                if reached.get((item, shift), -1) >= last:
                    continue
                own, starts = self.flat[item], self.starts[item]
                right = last + 1 + _agree(flat, last + 1, own, there + n)
                left = first - _agree_back(flat, first, own, there)
                reached[item, shift] = right - 1
                a, b = bisect_left(starts, left - shift), bisect_right(starts, right - shift) - 1
                if b - a < self.min_words:
                    continue
                if at is None:
                    at = bare_offsets(text)
                while a < b and not _border(at, starts[a] + shift):
                    a += 1
                while b > a and not _border(at, starts[b] + shift):
                    b -= 1
                if b - a >= self.min_words:
                    covered.setdefault(item, set()).update(range(a, b))
                    spans.setdefault(item, []).append((at[starts[a] + shift], at[starts[b] + shift - 1] + 1))
        out = {}
        for item, c in covered.items():
            merged: list[tuple[int, int]] = []
            for s, e in sorted(spans[item]):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            out[self.keys[item]] = (len(self.starts[item]) - 1, len(c), merged)
        return out


def _border(at: list[int], i: int) -> bool:
    """Whether something was left out of the text before place i of its bare form, or nothing stands before or behind."""
    return i == 0 or i == len(at) or at[i] - at[i - 1] > 1


def _agree(a: str, i: int, b: str, j: int) -> int:
    """Characters in which a from i and b from j agree."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def _agree_back(a: str, i: int, b: str, j: int) -> int:
    """Characters in which a up to i and b up to j agree, from the end."""
    n, most, step = 0, min(i, j), 16
    while n < most:
        step = min(step, most - n)
        if a[i - n - step : i - n] == b[j - n - step : j - n]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


OUT = "doc bigint, item bigint, n_words int, n_covered int, starts array<int>, ends array<int>"
_ARROW = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("n_words", pa.int32()), ("n_covered", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
#: The automaton that this process has built last, with the name of its test text.
_BUILT: dict[str, Seeds] = {}


def _scanner(shared, name: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factlake.llm import leakage  # the module of the process, not a copy

        if name not in leakage._BUILT:
            leakage._BUILT.clear()
            leakage._BUILT[name] = leakage.Seeds(shared.value, min_words)
        seeds = leakage._BUILT[name]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                for item, (size, n, spans) in seeds.scan(text).items():
                    rows.append((doc, item, size, n, [s for s, _ in spans], [e for _, e in spans]))
            cols = list(zip(*rows)) or [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    return run


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for key, text in items.toLocalIterator():
        block.append((key, " ".join(words(text))))
        size += len(block[-1][1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item, n_words, n_covered, starts, ends): every document with a stretch of min_words words of an item in a row.

    n_covered counts the item's words in such stretches, starts and ends are their places in the text as written. Case,
    accents, punctuation, spacing and markup don't count. Null and empty texts and passages, and passages of fewer words
    than min_words, give nothing. Repeated documents give a row each; items with one key should not be repeated.
    The normalised test text is sent to the tasks in blocks of block_chars characters (a longer passage is a block of its
    own). The corpus is scanned once a block, without a shuffle; the hits are written to the shared folder before the next
    block is sent, so that one block is held at a time. Keys must be whole numbers; other columns are ignored.
    """
    d = docs.select(F.col(doc).cast("bigint"), F.col(text))
    context = d.sparkSession.sparkContext
    out = d.sparkSession.createDataFrame([], OUT)
    for i, block in enumerate(_blocks(items.where(F.col(passage).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("bigint"), F.col(passage)), block_chars)):
        shared = context.broadcast(block)
        part = cut(d.mapInArrow(_scanner(shared, uuid.uuid4().hex, min_words), OUT))
        shared.destroy()
        out = part if not i else out.unionByName(part)
    return out


def leaked(hits: DataFrame, share: float = MIN_SHARE) -> DataFrame:
    """(doc, item) whose stretches make up at least `share` of the item's words."""
    return hits.where(F.col("n_covered") >= F.lit(share) * F.col("n_words")).select("doc", "item").distinct()
