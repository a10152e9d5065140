"""Garbled text from wrong character encoding.

A multinomial classifier over hashed byte bigrams (of neighbours and of bytes two apart) is trained on clean records
and on the same records garbled by every chain; it predicts the exact chain. A stretch counts as garbled if a chain is
more likely than clean text over it and the inverted chain decodes strictly into more likely clean text. Chains that
replace bytes they can't read (LOSSY) are classes too; what they leave is found, but nothing inverts them. A text is
judged again after each repair, until nothing garbled is left in it, so stretches of several chains are all put right.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chains, each a list of (encoding it was written in, encoding it was read in).
CHAINS = {
    "utf8-cp1252": [("utf-8", "cp1252")],
    "utf8-latin1": [("utf-8", "latin-1")],
    "utf8-cp1252-twice": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf8-cp437": [("utf-8", "cp437")],
    "utf8-cp850": [("utf-8", "cp850")],
    "utf8-mac": [("utf-8", "mac-roman")],
    "utf8-cp1251": [("utf-8", "cp1251")],
    "utf8-cp1253": [("utf-8", "cp1253")],
    "utf8-koi8": [("utf-8", "koi8-r")],
    "cp1252-cp437": [("cp1252", "cp437")],
    "cp1252-mac": [("cp1252", "mac-roman")],
    "cp1251-cp1252": [("cp1251", "cp1252")],
    "koi8-cp1251": [("koi8-r", "cp1251")],
    "cp1251-koi8": [("cp1251", "koi8-r")],
    "koi8-cp1252": [("koi8-r", "cp1252")],
    "cp1253-cp1252": [("cp1253", "cp1252")],
    "sjis-cp1252": [("shift_jis", "cp1252")],
    "eucjp-cp1252": [("euc_jp", "cp1252")],
}
#: Chains that put replacement characters for bytes they can't read.
LOSSY = {
    "cp1252-utf8-lost": ("cp1252", "utf-8"),
    "cp1251-utf8-lost": ("cp1251", "utf-8"),
    "cp1253-utf8-lost": ("cp1253", "utf-8"),
    "koi8-utf8-lost": ("koi8-r", "utf-8"),
    "sjis-utf8-lost": ("shift_jis", "utf-8"),
    "eucjp-utf8-lost": ("euc_jp", "utf-8"),
    "utf8-ascii-lost": ("utf-8", "ascii"),
}
_MANY_BYTES = ("utf-8", "shift_jis", "euc_jp")
#: Rows of the training sample, the most characters of one of them, and its different stretches that are garbled for each
#: chain; log-likelihood by which a chain must win.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_WORDS, MARGIN = 3_000, 4_000, 25_000, 8.0
_BUCKETS = 1 << 17
_ALPHA = 0.02
_ASIA = "　-鿿가-힯＀-￯"
#: A stretch without ASCII spaces that holds a character beyond ASCII; East Asian ones by themselves.
_UNIT = re.compile(rf"[{_ASIA}]+|(?<![^\x00-\x20{_ASIA}])(?>[!-\x7f]*)[^\x00-\x7f{_ASIA}][^\x00-\x20{_ASIA}]*")
_CHUNK = 100_000


@cache
def _bytes_of(encoding: str) -> tuple[str, dict[str, int]]:
    """The 256 characters of a one-byte encoding (undefined bytes give control characters), and back."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return "".join(chars), back


def garble(text: str, chain: str) -> str:
    """What a text becomes; characters that can't be written are left out."""
    if chain in LOSSY:
        written, read = LOSSY[chain]
        return text.encode(written, "ignore").decode(read, "replace")
    for written, read in CHAINS[chain]:
        chars = _bytes_of(read)[0]
        text = "".join([chars[b] for b in text.encode(written, "ignore")])
    return text


def restore(text: str, chain: str) -> str | None:
    """The text before the chain, or None if it can't be what the chain left (strict in both steps)."""
    if chain in LOSSY:
        return None
    for written, read in reversed(CHAINS[chain]):
        back = _bytes_of(read)[1]
        try:
            raw = bytes([back[c] for c in text])
            if written in _MANY_BYTES:
                text = raw.decode(written)
            else:
                chars = _bytes_of(written)[0]
                text = "".join([chars[b] for b in raw])
                if any("\x7f" <= c <= "\x9f" for c in text):
                    return None
        except (KeyError, UnicodeDecodeError):
            return None
    return text


#: Curly quotes, dashes and the like. They may end a stretch, but some chains make them.
_QUOTES = re.compile(r"([‘’“”„«»—–…]+)")


def units(text: str, split: bool = False) -> list[tuple[int, int]]:
    """Places of the stretches without ASCII spaces that hold a character beyond ASCII; East Asian ones by themselves.

    split: also at quotes and dashes, for garbled letters beside sound quotes.
    """
    if not split:
        return [m.span() for m in _UNIT.finditer(text)]
    out = []
    for m in _UNIT.finditer(text):
        at = m.start()
        for k, part in enumerate(_QUOTES.split(m[0])):
            if not k % 2 and part and not part.isascii():
                out.append((at, at + len(part)))
            at += len(part)
    return out


_WORD = re.compile(r"[^\W\d_]+")


def _script(c: str) -> int:
    return 0 if c < "\u0370" else 1 if c < "\u0400" else 2 if c < "\u0530" else 3


def _regular(text: str) -> bool:
    """Words of one script each, in small letters, in capitals, or with one capital at the start."""
    for w in _WORD.findall(text):
        if len({_script(c) for c in w}) > 1 or not (w[1:] == w[1:].lower() or w.isupper()):
            return False
    return True


def _pairs(text: str) -> list[str]:
    """Neighbouring characters, spaces outside, of which one at least is a letter beyond ASCII; East Asian ones left out."""
    t = f" {text} "
    return [t[i : i + 2] for i in range(len(t) - 1) if not t[i : i + 2].isascii() and max(t[i : i + 2]) < "\u2000"]


def _features(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all pieces, and where each piece begins among them (a multiple of two a byte)."""
    data = np.frombuffer(b"".join([b" " + p + b" " for p in pieces]) + b"\0\0", np.uint8).astype(np.int64)
    near = data[:-2] * 256 + data[1:-1]
    far = 65_536 + data[:-2] * 256 + data[2:]
    lengths = np.array([len(p) + 2 for p in pieces])
    ends = np.cumsum(lengths)
    far[ends - 2] = far[ends - 1] = near[ends - 1] = 65_536  # nothing reaches into the next piece
    out = np.empty(2 * len(near), np.int64)
    out[0::2], out[1::2] = near, far
    return out, 2 * (ends - lengths)


class Classifier:
    """Log-probabilities of features: row by feature, column 0 clean text, then one column a chain.

    pairs: the pairs of neighbouring letters, one at least beyond ASCII, that clean text has.
    """

    #: Stretches whose scores a model remembers; beyond this number it forgets them all.
    KNOWN = 100_000

    def __init__(self, names: list[str], weights: np.ndarray, pairs: set[str]):
        self.names, self.weights, self.pairs = names, weights, pairs
        self._best = (weights[:, 1:] - weights[:, :1]).max(1)  # what one feature can speak for any chain
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return self.names, self.weights, self.pairs

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def train(cls, texts: list[str], rounds: int = 2) -> Classifier:
        """Fit to clean texts; those that the first model clearly takes for garbled are left out of the next."""
        names = [*CHAINS, *LOSSY]
        index: dict[str, int] = {}
        of = [np.array([index.setdefault(t[a:b], len(index)) for a, b in units(t)], np.int64) for t in texts]
        words = list(index)
        shown: list[tuple[np.ndarray, np.ndarray]] = []
        sample = [words[i] for i in range(0, len(words), len(words) // TRAIN_WORDS + 1)]
        sampled = range(0, len(words), len(words) // TRAIN_WORDS + 1)
        for chain in (None, *names):
            some = range(len(words))
            forms = words
            if chain:
                made = [(i, g) for i, u in zip(sampled, sample) if (g := garble(u, chain)) != u and ("\ufffd" in g if chain in LOSSY else restore(g, chain) == u)]
                some, forms = [i for i, _ in made], [g for _, g in made]
            pieces = [p.encode("utf-8", "surrogatepass") for p in forms]
            f = _features(pieces)[0].astype(np.int32) if pieces else np.zeros(0, np.int32)
            shown.append((f, np.repeat(np.array(some, np.int32), [2 * (len(p) + 2) for p in pieces])))
        keep, model = range(len(texts)), None
        for _ in range(rounds):
            n = np.zeros(max(1, len(words)))
            for k in keep:
                np.add.at(n, of[k], 1)
            counts = np.stack([np.bincount(f, weights=n[u], minlength=_BUCKETS) for f, u in shown], 1)
            counts[65_536] = 0
            w = np.log((counts + _ALPHA) / (counts.sum(0) + _ALPHA * _BUCKETS)).astype(np.float32)
            w[65_536] = 0
            w[:, 1:][:, counts[:, 1:].sum(0) == 0] = -30.0  # chains that the sample can't show
            pairs = Counter(p for i, u in enumerate(words) for p in set(_pairs(u)) for _ in range(min(2, int(n[i]))))
            model = cls(names, w, {p for p, k in pairs.items() if k > 1})
            model.learn(words)
            keep = [k for k in keep if model.repair(texts[k], 2 * MARGIN) is None]
        return model

    def sound(self, text: str) -> bool:
        """Whether restored text is regular and most of its letter pairs beyond ASCII are those of clean text."""
        p = _pairs(text)
        return _regular(text) and 4 * sum(x in self.pairs for x in p) >= 3 * len(p)

    def scores(self, pieces: list[str]) -> np.ndarray:
        """Log-likelihood of each piece under each class."""
        return self._sums(pieces, self.weights)

    def _sums(self, pieces: list[str], table: np.ndarray) -> np.ndarray:
        out, group, size = [], [], 0
        for i, p in enumerate(pieces):
            group.append(p.encode("utf-8", "surrogatepass"))
            size += len(group[-1])
            if size > _CHUNK or i == len(pieces) - 1:
                f, starts = _features(group)
                out.append(np.add.reduceat(table[f], starts, axis=0, dtype=np.float64))
                group, size = [], 0
        return np.concatenate(out) if out else np.zeros((0, *table.shape[1:]))

    def learn(self, pieces: Iterable[str]) -> None:
        """Find by how much pieces are likelier under any chain than as clean text, 0 if not; each different one is scored once.

        The sum of what each feature can speak for any chain bounds what they speak for one; most pieces are clean by it.
        """
        new = list({p for p in pieces if p not in self._known})
        if len(self._known) + len(new) > self.KNOWN:
            self._known.clear()
            new = list(set(pieces))
        self._known.update(dict.fromkeys(new, 0.0))
        some = [p for p, x in zip(new, self._sums(new, self._best)) if x > 0]
        s = self.scores(some)
        self._known.update((p, float(x[1:].max() - x[0])) for p, x in zip(some, s) if x[1:].max() > x[0])

    def judge(self, text: str, spans: list[tuple[int, int]], margin: float = MARGIN) -> tuple[str, int, int, dict[int, str]] | None:
        """(chain, first span, last span, restored spans by number) of the most likely garbled stretch of a text, or None.

        No span is restored where the chain is one of LOSSY.
        """
        scores = self.scores([text[a:b] for a, b in spans])
        gain = scores[:, 1:] - scores[:, :1]
        best = None
        speaks = np.maximum(gain, 0).sum(0)
        for c in np.argsort(-gain.max(0)):
            if speaks[c] < margin:
                continue
            chain, v = self.names[c], gain[:, c].copy()
            back: dict[int, str] = {}
            if chain in LOSSY:  # it leaves a replacement character, or nothing is lost
                v = np.where(["\ufffd" in text[a:b] for a, b in spans], v, np.minimum(v, -1.0))
            else:
                plus = np.nonzero(v > 0)[0]
                found = {i: restore(text[spans[i][0] : spans[i][1]], chain) for i in plus}
                one_byte = CHAINS[chain][0][0] not in _MANY_BYTES
                # where any bytes decode, the outcome must look like text
                back = {i: u for i, u in found.items() if u is not None and (not one_byte or self.sound(u))}
                known = list(back)
                v[[i for i in plus if i not in back]] = -1.0
                if known:
                    better = self.scores([back[i] for i in known])[:, 0] - scores[known, 0]
                    v[known] = np.where(better < 1.0, -1.0, np.minimum(v[known], better))
                if one_byte and not any(v[i] > 0 and any(len(w) > 1 and not w.isascii() for w in _WORD.findall(back[i])) for i in known):
                    continue
            total, start, top = 0.0, 0, (0.0, 0, 0)
            for i, x in enumerate(v):
                if total <= 0:
                    total, start = 0.0, i
                total += x
                if total > top[0]:
                    top = (total, start, i)
            if top[0] >= margin and (best is None or top[0] > best[0]):
                best = (top[0], chain, top[1], top[2], {k: u for k, u in back.items() if top[1] <= k <= top[2]})
        return best and best[1:]

    def repair(self, text: str, margin: float = MARGIN) -> tuple[str, int, int, str | None, bool] | None:
        """(chains, start, stop, restored, complete) of a text with a garbled stretch, else None.

        The text is judged again after each repair: what is likelier as clean text by then only grows, so this ends. start and
        stop are the places of the first stretch found. restored is None if nothing could be put right; complete is False
        if some stretch has lost bytes.
        """
        chains: list[str] = []
        place, lost, now = None, set(), text
        for split in (False, True):
            if split and not _QUOTES.search(now):
                break
            while True:
                spans = [(a, b) for a, b in units(now, split) if now[a:b] not in lost]
                self.learn([now[a:b] for a, b in spans])
                if sum(self._known[now[a:b]] for a, b in spans) < margin or not (hit := self.judge(now, spans, margin)):
                    break
                chain, i, j, back = hit
                place = place or (spans[i][0], spans[j][1])
                if chain not in chains:
                    chains.append(chain)
                if chain in LOSSY:
                    lost.update(now[a:b] for a, b in spans[i : j + 1])
                    continue
                out, at = [], 0
                for k in sorted(back):
                    out += [now[at : spans[k][0]], back[k]]
                    at = spans[k][1]
                now = "".join(out) + now[at:]
        return place and ("+".join(chains), *place, now if now != text else None, not lost)

    def repair_many(self, docs: list[tuple[int, str]]) -> list[tuple]:
        """(doc, chains, start, stop, restored, complete) of the garbled ones among (doc, text)."""
        whole = [_UNIT.findall(t) for _, t in docs]
        parts = [[p for u in us if _QUOTES.search(u) for p in _QUOTES.split(u)[::2] if p and not p.isascii()] if _QUOTES.search(t) else [] for (_, t), us in zip(docs, whole)]
        self.learn(set().union(*whole, *parts))
        speaks = lambda pieces: sum(map(self._known.get, pieces))
        return [(doc, *hit) for (doc, t), us, ps in zip(docs, whole, parts) if (x := speaks(us)) >= MARGIN or ps and x + speaks(ps) >= MARGIN if (hit := self.repair(t))]


OUT = "doc bigint, chain string, start int, stop int, restored string, complete boolean"
_ARROW = pa.schema([("doc", pa.int64()), ("chain", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("restored", pa.string()), ("complete", pa.bool_())])


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, docs, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or text.isascii():
                    continue
                docs.append((doc, text))
                size += len(text)
                if size > 1_000_000:
                    rows += model.repair_many(docs)
                    docs, size = [], 0
            rows += model.repair_many(docs)
            cols = list(zip(*rows)) or [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    return run


def train_on(docs: DataFrame, doc: str, text: str, rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier fitted to at most `rows` texts of at most TRAIN_CHARS characters, chosen by a hash of their key."""
    some = docs.where(f"length({text}) between 1 and {TRAIN_CHARS}").select(doc, text).orderBy(F.xxhash64(F.lit(42), F.col(doc))).limit(rows)
    return Classifier.train([r[1] for r in some.collect()])


def garbled(docs: DataFrame, doc: str, text: str, model: Classifier | None = None) -> DataFrame:
    """(doc, chain, start, stop, restored, complete) of every text with a garbled stretch.

    restored is the whole text with all that can be put right, null where nothing can; complete is false where bytes are
    lost (replacement characters). Several chains are joined by `+`. Null, empty and ASCII texts give nothing; repeated
    rows give a row each. Whole texts are judged; only the training sample is bounded (TRAIN_ROWS). The model is one table
    of 2^17 rows and is broadcast; pass one in to train once for many calls. Other columns are ignored.
    """
    model = model or train_on(docs, doc, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc).cast("bigint"), F.col(text)).mapInArrow(_finder(shared), OUT)
