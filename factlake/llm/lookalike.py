"""Visually identical text with different characters.

One form per text: compatibility normalisation (composed), mapped white space, default-ignorable characters removed,
look-alike letters of other scripts mapped to one letter, full case folding on request. The form is computed once per
distinct text of an Arrow batch.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.skew import SHARE, hot_hashes, salted_join
from factlake.session import cut, cut_observed, drop_cut

#: Letters of Greek and Cyrillic that are drawn as a Latin letter, and that letter.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "νορϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYX" + "vopcj"
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜ" + "аеѕіјорсухԛԝһԁ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXYQW" + "aesijopcyxqwhd"
#: Hyphens drawn as the ASCII one. Longer dashes are not.
HYPHENS = "‐‑⁃﹣"
#: Kinds of compatibility characters that are drawn differently from what they stand for.
DRAWN_APART = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Default-ignorable code points (ranges).
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


@cache
def _tables():
    drop = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]+")
    letters = dict(zip(map(ord, GREEK + CYRILLIC), GREEK_LATIN + CYRILLIC_LATIN))
    letters |= {ord(c): "-" for c in HYPHENS}
    apart = "".join(chr(i) for i in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(i)).startswith(DRAWN_APART))
    return drop, letters, re.compile(f"([{re.escape(apart)}]+)"), re.compile(r"\s")


def look(text: str, fold: bool = False) -> str:
    """The form under which texts that look alike are equal.

    Not changed by it: letter case (but for fold=True, full case folding), accents, punctuation, the length of dashes,
    the number of spaces inside. Spaces and invisible characters at either end go. A text of nothing else gives "".
    """
    if text.isascii():
        t = text.strip()
        return t.casefold() if fold else t
    drop, letters, apart, space = _tables()
    t = space.sub(" ", drop.sub("", text))
    t = "".join(p if i % 2 else unicodedata.normalize("NFKC", p) for i, p in enumerate(apart.split(t)))
    t = unicodedata.normalize("NFD", drop.sub("", t)).translate(letters)
    t = unicodedata.normalize("NFC", t).strip()
    return unicodedata.normalize("NFC", t.casefold()) if fold else t


def _forms(fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(2).dictionary_encode()
            forms = pa.array([look(t, fold) for t in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, forms.take(coded.indices)], names=["key", "part", "text", "form"])

    return run


def with_forms(texts: DataFrame, key: str, part: str, text: str, fold: bool = False) -> DataFrame:
    """(key, part, text, form) of every row with a text; the form is made once per different text of a batch.

    Null texts are left out, empty ones have the form "".
    """
    t = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(part).alias("part"), F.col(text).alias("text"))
    return t.mapInArrow(_forms(fold), "key bigint, part string, text string, form string")


def alike(texts: DataFrame, key: str, part: str, text: str, fold: bool = False) -> DataFrame:
    """(key, part, text, form) of all rows whose form is shared by a different text of the same part.

    Forms are made and written once. Groups of a form are told from hashes first, so that rows of forms that only one
    text has leave early; the few rows that stay are then compared by their texts. Keys of much repeated forms are spread
    over tasks. A null part is a part of its own. Repeated rows give one.
    """
    hashed = [F.xxhash64("part", "form").alias("h"), F.struct(F.xxhash64("text").alias("a"), F.crc32(F.encode("text", "utf-8")).alias("b")).alias("t")]
    rows, seen = cut_observed(with_forms(texts, key, part, text, fold).select("*", *hashed), n=F.count(F.lit(1)))
    groups = rows.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count(F.lit(1)).alias("n"))
    some = cut(groups.select("h", "n", (F.col("low") != F.col("high")).alias("varies")).where(F.col("varies") | (F.col("n") > (seen["n"] or 0) / SHARE)))
    hot = [r[0] for r in some.where(F.col("n") > (seen["n"] or 0) / SHARE).select(F.xxhash64("h")).collect()]  # at most SHARE numbers
    few = cut(salted_join(rows, some.where("varies").select("h"), ["h"], "left_semi", hot).select("key", "part", "text", "form").distinct())
    drop_cut(rows, some)
    vary = few.groupBy("part", "form").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high")
    f, v = few.alias("f"), vary.alias("v")
    return f.join(v, F.col("f.part").eqNullSafe(F.col("v.part")) & (F.col("f.form") == F.col("v.form")), "left_semi")


def alike_pairs(texts: DataFrame, key: str, part: str, text: str, fold: bool = False) -> DataFrame:
    """(key_a, key_b), smaller key first: rows of one part that look the same but hold different code points.

    Different texts of a form are paired first, each pair once; only then do the rows that hold them come in. So rows of
    equal texts never meet, however many there are. Both joins spread the texts that hold many rows.
    """
    r = cut(alike(texts, key, part, text, fold).select("key", F.coalesce("part", F.lit("\0")).alias("part"), "text", "form"))
    t = r.select("part", "form", "text").distinct()
    on = ["part", "form"]
    a, b = t.withColumnRenamed("text", "text_a"), t.withColumnRenamed("text", "text_b")
    pairs = salted_join(a, b, on, "inner", hot_hashes(a, on)).where("text_a < text_b").select("part", "text_a", "text_b")
    rows = r.select("part", "key", "text")
    hot = hot_hashes(rows, ["part", "text"])  # hashes of values, whatever the columns are called
    left = rows.select("part", F.col("text").alias("text_a"), F.col("key").alias("key_a"))
    right = rows.select("part", F.col("text").alias("text_b"), F.col("key").alias("key_b"))
    first = salted_join(left, pairs, ["part", "text_a"], "inner", hot)
    both = salted_join(right, first, ["part", "text_b"], "inner", hot)
    return both.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).where("key_a <> key_b").distinct()
