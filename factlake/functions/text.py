"""Text functions, as built-in column expressions where they can be."""

from __future__ import annotations

import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Prefixes of namespaces that are taken off terms.
NAMESPACES = (
    "http://kb.example/entity/", "http://kb.example/prop/direct/", "http://kb.example/prop/", "http://kb.example/resource/", "http://kb.example/ontology/", "http://kb.example/property/",
    "http://en.kb.example/wiki/", "http://xmlns.com/foaf/0.1/", "http://purl.org/dc/elements/1.1/",
)
#: What is no part of a word, before and after it.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column, punctuation: bool = False, article: bool = False, lower: bool = True) -> Column:
    """Normal form of a label: format characters off, NFKC, small letters, runs of three letters to two, spaces evened.

    article: take off a, an, the, and. punctuation: take off ASCII punctuation, unless nothing would be left.
    """
    t = nfkc(F.regexp_replace(c, r"\p{Cf}", ""))
    if lower:
        t = F.lower(t)
    if article:
        t = F.regexp_replace(t, f"{_BEFORE}(a|an|the|and){_AFTER}", " ")
    t = F.regexp_replace(t, r"([A-Za-z])\1{2,}", "$1$1")
    if punctuation:
        bare = F.regexp_replace(t, r"[\p{Punct}]", "")
        t = F.when(F.trim(bare) != "", bare).otherwise(t)
    return squeeze(t)


def strip_namespaces(c: Column) -> Column:
    for p in NAMESPACES:
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.translate(c, "<>", "")


def norm_query(c: Column) -> Column:
    """norm_text without articles and without a leading `re:`."""
    t = norm_text(c, article=True)
    return F.when(t.startswith("re:"), F.substring(t, 4, 1 << 30)).otherwise(t)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_brackets(c: Column) -> Column:
    """Take off the links of a title-like text.

    `[[...]]` goes with its text where `#` is in the text (if that changes nothing, the text becomes empty), also if it
    never closes; what stands before `]]` goes if nothing opens. A text with `see` becomes empty. A parenthesis goes if
    the other kind is wholly absent.
    """
    has = lambda x, part: x.contains(part)
    t = c
    linked = F.regexp_replace(t, r"\[\[(.*)\]\]", "")
    t = F.when(has(t, "[[") & has(t, "]]") & has(t, "#"), F.when(linked == t, F.lit("")).otherwise(_strip(linked))).otherwise(t)
    t = F.when(has(t, "[[") & has(t, "#") & ~has(t, "]]"), _strip(F.regexp_replace(t, r"\[\[(.*)", ""))).otherwise(t)
    t = F.when(has(t, "]]") & ~has(t, "[["), _strip(F.regexp_replace(t, r"(.*)\]\]", ""))).otherwise(t)
    t = F.when(has(F.lower(t), "see"), F.lit("")).otherwise(t)
    t = F.when(has(t, "(") & ~has(t, ")"), _strip(F.translate(t, "(", ""))).otherwise(t)
    return F.when(has(t, ")") & ~has(t, "("), _strip(F.translate(t, ")", ""))).otherwise(t)


def remove_parts(c: Column, parts: list[str]) -> Column:
    """Each of the parts replaced by a space."""
    for p in parts:
        c = F.replace(c, F.lit(p), F.lit(" "))
    return F.trim(c)


def remove_spans(c: Column, spans: list[tuple[str, str]]) -> Column:
    """Everything from a start to the next end off, for each (start, end) in turn; a start without an end stays."""
    for a, b in spans:
        c = F.regexp_replace(c, f"(?s)\\Q{a}\\E.*?\\Q{b}\\E", "")
    return F.trim(c)


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"<[^<>]*>", " "))


def abbreviate(c: Column) -> Column:
    """`Ada Lovelace King` -> `A. Lovelace King`; one word gives null."""
    w = F.split(F.trim(c), r"\s+")
    return F.when(F.size(w) > 1, F.concat(F.left(w[0], F.lit(1)), F.lit(". "), F.array_join(F.slice(w, F.lit(2), F.size(w)), " ")))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def delete_edits(word: str, distance: int, prefix: int, shortest: int = 1) -> set[str]:
    """All different texts left by deleting up to `distance` characters of the first `prefix`; the text itself is one."""
    w = word[:prefix]
    out = {w} if w else set()
    for k in range(max(shortest, len(w) - distance), len(w)):
        out |= {"".join(x) for x in combinations(w, k)}
    return out


def ngrams(words: Column, n: int) -> Column:
    """Array of the n-grams of an array of words, joined by spaces; fewer words than n give an empty array."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))
