"""Queries of the text problems (p4, p5, p8, p9, p10) over whole tables, and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import leakage, lookalike, markup, mojibake, tokens
from factlake.plans import views
from factlake.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.alike_pairs(table(spark, d, "wd_term"), "term_id", "lang", "text")
    return pairs.select(F.col("key_a").alias("term_id_a"), F.col("key_b").alias("term_id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per term whose text looks like another one of its language: its class is the folded form."""
    return lookalike.alike(table(spark, d, "wd_term"), "term_id", "lang", "text", fold=True).select(F.col("key").alias("term_id"), F.col("part").alias("lang"), "form")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "wp_dump").where("redirect is null")
    return markup.page_elements(pages, "page_id", "wiki_text").select(F.col("key").alias("page_id"), "kind", "seq")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every row of wp_dump."""
    return markup.clean_pages(table(spark, d, "wp_dump"), "page_id", "wiki_text").withColumnRenamed("key", "page_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "passage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_leaks(spark, d)).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked stretch with its place in the document as written."""
    h = _leaks(spark, d).select("doc", "item", F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return h.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("s.starts").alias("start"), F.col("s.ends").alias("stop"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id")).distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled document with the chain that was found and the text put right, null where it can't be."""
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_classes, p5_found, p5_clean, p8_ids, p9_found, p9_spans, p10_found, p10_restored)}


def _looks() -> str:
    """The form of look-alikes as a map for SQL, character by character: by rule from the tables of the operator."""
    drop, letters, apart, space = lookalike._tables()
    sides: tuple[list[str], list[str]] = ([], [])
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        k = "" if drop.match(c) else " " if space.match(c) else c if apart.match(c) else unicodedata.normalize("NFKD", c)
        form = drop.sub("", unicodedata.normalize("NFD", k)).translate(letters)
        if form != unicodedata.normalize("NFD", c):
            sides[0].append(c)
            sides[1].append(form)
    text = lambda x: "chr(" + str(ord(x)) + ")" if len(x) == 1 and ord(x) < 32 else "'" + x.replace("'", "''") + "'"
    return f"map([{', '.join(map(text, sides[0]))}], [{', '.join(map(text, sides[1]))}])"


_BLANKS = " || ".join(f"chr({i})" for i in (*range(9, 14), *range(28, 33)))
_FORM = f"case when regexp_full_match(text, '[\\x00-\\x7F]*') then trim(text, {_BLANKS}) else trim(nfc_normalize(array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: coalesce({_looks()}[c], c)), '')), ' ') end"
_ALIKE = f"""with f as (select distinct term_id, coalesce(lang, chr(0)) as lang, text, {_FORM} as form from wd_term where text is not null)
select distinct a.term_id as term_id_a, b.term_id as term_id_b from f a join f b on a.lang = b.lang and a.form = b.form and a.text <> b.text and a.term_id < b.term_id"""


def _bare_sql(x: str) -> str:
    """A text without markup, small letters without accents; what is no letter or digit is still there."""
    plain = f"regexp_replace({x}, '(?s){leakage._MARKUP.pattern}', '', 'g')"
    return f"strip_accents(replace(replace(lower({views.sql_nfkc(plain)}), 'ß', 'ss'), 'ς', 'σ'))"


_LEAKS = rf"""with it as (select item_id, list_filter(list_transform(string_split_regex({_bare_sql('passage')}, '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: w <> '') as ws from eval_item where passage is not null),
wi as (select item_id, len(ws) as n, unnest(generate_series(1, len(ws) - 7)) as i, ws from it where len(ws) >= 8), wp as (select item_id, n, i, array_to_string(ws[i:i + 7], '') as p from wi),
dc as (select doc_id, regexp_replace({_bare_sql('text')}, '[^\p{{L}}\p{{N}}]', '', 'g') as t from documents where text <> ''),
hit as (select distinct d.doc_id, w.item_id, w.n, w.i from dc d join wp w on contains(d.t, w.p)), cov as (select distinct doc_id, item_id, n, i + k as word from hit, unnest(generate_series(0, 7)) x(k))
select doc_id, item_id from cov group by doc_id, item_id, n having count(*) >= 0.25 * n"""

ORACLE: dict[str, str] = {"p4_found": _ALIKE, "p9_found": _LEAKS}
