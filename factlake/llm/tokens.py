"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

The tokenizer first splits a text by its pattern; a piece is then merged on its own. Pieces longer than LONG (text
without any split) are encoded by tree concatenation: both halves for themselves, then a growing window of tokens
around the join is encoded again until its outer tokens agree with both sides; that is exact, because a token sequence
is the encoding of its text if every two neighbours are the encoding of theirs.
Texts longer than LONG_TEXT are cut into parts that different tasks encode: at pattern borders where they can be, and
through an unsplit piece where it is longer than a part; the chunks of such a piece are then joined as a tree.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("FACTLAKE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern by which byte_bpe_50k splits texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters: pieces beyond LONG are halved, texts beyond LONG_TEXT are shared among tasks in parts of PART.
LONG, LONG_TEXT, PART = 4_000, 100_000, 50_000


@cache
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """A tiktoken encoding made from the ranks in folder/name.tiktoken, without special tokens."""
    return _make(name, _vocabulary(folder, name))


def _vocabulary(folder: str, name: str) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def _make(name: str, data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Encodings this process has made from a vocabulary that the job brought along.
_MADE: dict[tuple[str, int], object] = {}


def _shipped(name: str, shared):
    """The encoding of a broadcast vocabulary, made once a process."""
    from factlake.llm import tokens  # the module of the process, not a copy

    data = shared.value
    key = name, hash(data)
    if key not in tokens._MADE:
        tokens._MADE[key] = _make(name, data)
    return tokens._MADE[key]


@cache
def _splitter():
    import regex

    return regex.compile(PATTERN)


def join_tokens(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], decode: Callable[[list[int]], bytes], window: int = 4) -> list[int]:
    """Tokens of the joined text, from the tokens of both parts.

    The last i tokens of left and the first j of right are encoded anew; it is done where the new tokens start with the
    first of those i and end with the last of those j (or the window has reached the end of that side). Otherwise the
    window grows on the side that doesn't agree.
    """
    if not left or not right:
        return left + right
    i, j = min(window, len(left)), min(window, len(right))
    while True:
        mid = encode(decode(left[len(left) - i :]) + decode(right[:j]))
        fits_left = i == len(left) or mid[0] == left[len(left) - i]
        fits_right = j == len(right) or mid[-1] == right[j - 1]
        if fits_left and fits_right and len(mid) > 1 or i == len(left) and j == len(right):
            return left[: len(left) - i] + mid + right[j:]
        if not fits_left or len(mid) == 1:
            i = min(2 * i, len(left))
        if not fits_right or len(mid) == 1:
            j = min(2 * j, len(right))


def encode_piece(piece: bytes, enc, limit: int = LONG) -> list[int]:
    """Tokens of one unsplit piece, by halves if it is longer than limit."""
    if len(piece) <= limit:
        return enc._encode_single_piece(piece)
    half = len(piece) // 2
    return join_tokens(encode_piece(piece[:half], enc, limit), encode_piece(piece[half:], enc, limit), lambda b: encode_piece(b, enc, max(limit, 2 * len(b))), enc.decode_bytes)


def encode_text(text: str | None, enc, limit: int = LONG) -> list[int]:
    """Token ids of a text; null and empty texts give the empty list."""
    if not text:
        return []
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    pieces = _splitter().findall(text)
    if max(map(len, pieces)) <= limit:
        return enc.encode_ordinary(text)
    return [t for p in pieces for t in encode_piece(p.encode(), enc, limit)]


#: Kinds of parts: text that is split by the pattern, the first chunk of a long piece, a chunk that follows another.
TEXT, CHUNK, NEXT_CHUNK = 0, 1, 2


def split_text(text: str, size: int = PART) -> list[tuple[int, str]]:
    """(kind, part): parts of about `size` characters whose tokens, chunks of one piece joined, are those of the whole.

    A part ends where the pattern splits and not in white space: how white space splits depends on what follows it. A
    piece longer than size is cut into chunks; white space directly before it stands for itself.
    """
    parts, start = [], 0
    blank: list[str] = []  # the last pieces, as far as they are white space
    for m in _splitter().finditer(text):
        if m.end() - m.start() > size:
            before = m.start() - sum(map(len, blank))
            if before > start:
                parts.append((TEXT, text[start:before]))
            parts += [(CHUNK, b) for b in blank]
            parts += [(NEXT_CHUNK if i > m.start() else CHUNK, text[i : min(i + size, m.end())]) for i in range(m.start(), m.end(), size)]
            start, blank = m.end(), []
        elif m[0][-1].isspace():
            blank.append(m[0])
        else:
            blank = []
            if m.end() - start >= size:
                parts.append((TEXT, text[start : m.end()]))
                start = m.end()
    if start < len(text):
        parts.append((TEXT, text[start:]))
    return parts


def join_parts(parts: list[tuple[int, list[int]]], enc) -> list[int]:
    """Tokens of a text from those of its parts (kind, tokens), in order: chunks of one piece are joined two by two."""
    encode = lambda b: encode_piece(b, enc, max(LONG, 2 * len(b)))
    out: list[int] = []
    i = 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and parts[j][0] == NEXT_CHUNK:
            j += 1
        level = [ids for _, ids in parts[i:j]]
        while len(level) > 1:
            level = [join_tokens(level[k], level[k + 1], encode, enc.decode_bytes) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        out += level[0]
        i = j
    return out


_OUT = pa.list_(pa.int32())


def _encode_rows(name: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _shipped(name, shared)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                ids = pa.array([encode_text(t, enc) for t in part.column(1).to_pylist()], _OUT)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return run


def _encode_parts(name: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _shipped(name, shared)
        for b in batches:
            for s in range(0, b.num_rows, 100):
                part = b.slice(s, 100)
                ids = pa.array([encode_text(t, enc) if k == TEXT else encode_piece(t.encode(), enc) for k, t in zip(part.column(3).to_pylist(), part.column(4).to_pylist())], _OUT)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], ids], names=["row", "key", "i", "kind", "ids"])

    return run


def _join_rows(name: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _shipped(name, shared)
        for b in batches:
            for s in range(0, b.num_rows, 10):
                part = b.slice(s, 10)
                ids = pa.array([join_parts([(p["kind"], p["ids"]) for p in ps], enc) for ps in part.column(1).to_pylist()], _OUT)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return run


def _split_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row += 1
                parts = split_text(text, size)
                for s in range(0, len(parts), 8):
                    some = parts[s : s + 8]
                    n = len(some)
                    cols = [([row] * n, pa.int64()), ([key] * n, pa.int64()), (range(s, s + n), pa.int32()), ([k for k, _ in some], pa.int32()), ([t for _, t in some], pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["row", "key", "i", "kind", "text"])

    return run


def encode_corpus(docs: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", long_text: int = LONG_TEXT, part: int = PART) -> DataFrame:
    """(key, ids) of every row: null and empty texts give the empty list, repeated rows give a row each.

    Rows with a null key are kept. Texts up to long_text characters are encoded where they are read, without a shuffle;
    the parts of longer ones, chunks of unsplit pieces too, are spread over the tasks and put together again. The
    vocabulary is read from folder on the driver and goes with the job; its size is that of the tokenizer.
    """
    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    shared = d.sparkSession.sparkContext.broadcast(_vocabulary(folder, name))
    short = d.where(f"text is null or length(text) <= {long_text}").mapInArrow(_encode_rows(name, shared), "key bigint, ids array<int>")
    parts = d.where(f"length(text) > {long_text}").mapInArrow(_split_rows(part), "row bigint, key bigint, i int, kind int, text string").repartition("row", "i")
    done = parts.mapInArrow(_encode_parts(name, shared), "row bigint, key bigint, i int, kind int, ids array<int>")
    whole = done.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "ids"))).alias("parts")).select("key", "parts")
    return short.unionByName(whole.mapInArrow(_join_rows(name, shared), "key bigint, ids array<int>"))
