"""Readers and writers of plain files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators.widen import unescape

#: Namespaces of pages that are not read. Categories are.
IGNORED_NAMESPACES = ("wikipedia:", "file:", "portal:", "template:", "mediawiki:", "user:", "help:", "book:", "draft:", "module:", "timedtext:")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of plain, .gz or .bz2 files."""
    return spark.read.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines by a given schema; broken lines are left out. limit: only so many rows."""
    df = spark.read.text(path).select(F.from_json("value", schema).alias("j"), "value").where("j is not null").select("j.*")
    return df.limit(limit) if limit else df


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array or object each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; members that are null are left out."""
    df.write.mode("overwrite").json(path)


def save(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Keep a table for later runs, compressed; replaces what is there."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated, every value quoted; replaces what is there only when the new files are complete."""
    df.write.mode("overwrite").option("quoteAll", True).option("escape", '"').csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, redirect, text) of a MediaWiki export; pages of namespaces that are not read are left out."""
    schema = "title string, ns int, redirect struct<_title:string>, revision struct<text:string>"
    x = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", False).schema(schema).load(path)
    return x.select("title", "ns", F.col("redirect._title").alias("redirect"), F.col("revision.text").alias("text")).where(~ignored(F.col("title")))


def ignored(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike("^(" + "|".join(IGNORED_NAMESPACES) + ")"), F.lit(False))


def write_pages(pages: DataFrame, path: str) -> None:
    """A MediaWiki export of (title, ns, redirect, text) that read_pages reads back."""
    x = pages.select("title", "ns", F.when(F.col("redirect").isNotNull(), F.struct(F.col("redirect").alias("_title"))).alias("redirect"), F.struct("text").alias("revision"))
    x.write.mode("overwrite").format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)


def parse_triples(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(head, prop, tail) of N-Triples lines, terms as written; comments, blank and short lines are left out.

    keep: other columns that go along.
    """
    p = F.split(F.trim(F.col(value)), " ", 3)
    t = lines.where(~F.trim(F.col(value)).startswith("#")).select(*(keep or []), F.get(p, F.lit(0)).alias("head"), F.get(p, F.lit(1)).alias("prop"), F.regexp_replace(F.get(p, F.lit(2)), r"\s*\.\s*$", "").alias("tail"))
    return t.where("tail is not null and tail <> ''")


def with_any(lines: DataFrame, words: list[str], value: str = "value") -> DataFrame:
    """Lines that hold any of the words: what is asked of link dumps before they are split."""
    test = F.lit(False)
    for w in words:
        test = test | F.col(value).contains(w)
    return lines.where(test)


def in_domain(triples: DataFrame, head: str | None = None, prop: str | None = None, tail: list[str] | None = None) -> DataFrame:
    """Triples whose head and property contain a namespace, and whose tail contains one of some."""
    for c, part in (("head", head), ("prop", prop)):
        if part:
            triples = triples.where(F.col(c).contains(part))
    return with_any(triples, tail, "tail") if tail else triples


#: Namespaces that short names stand for.
PREFIXES = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "xml": "http://www.w3.org/XML/1998/namespace",
}


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Escapes of N-Triples resolved; texts without a backslash pass as they are."""
    return s.map(lambda t: t if t is None or "\\" not in t else unescape(t))


def local(term: Column) -> Column:
    """Last part of a URI without angle brackets; a short spelling stays as it is."""
    t = F.translate(F.trim(term), "<>", "")
    return F.when(t.contains("://"), F.regexp_extract(F.regexp_replace(t, "/+$", ""), "[^/#]*$", 0)).otherwise(t)


def _expanded(c: Column) -> Column:
    """`xsd:int` -> its URI; unknown prefixes stay as written."""
    out = c
    for p, uri in PREFIXES.items():
        out = F.when(c.startswith(f"{p}:"), F.concat(F.lit(uri), F.substring(c, len(p) + 2, 1 << 30))).otherwise(out)
    return out


def literal(tail: Column) -> Column:
    """Struct (kind, value, lang, dtype) of an N-Triples term.

    kind: uri (also of a short name with a known prefix, written out), literal (unescaped; a datatype written out wins over
    a language), bool, int, blank or name, which is anything else, as it is.
    """
    lit = r'^"([\s\S]*)"(?:@([A-Za-z0-9-]+)|\^\^<?([^<>"\s]+)>?)?$'
    part = lambda i: F.nullif(F.regexp_extract(tail, lit, i), F.lit(""))
    short = tail.rlike("^(?:" + "|".join(PREFIXES) + "):")
    kind = F.when(tail.rlike(lit), "literal").when(tail.rlike("^<.*>$|^https?://") | short, "uri").when(tail.isin("true", "false"), "bool").when(tail.rlike("^[0-9]+$"), "int").when(tail.startswith("_:"), "blank").otherwise("name")
    value = F.when(tail.rlike(lit), F.regexp_extract(tail, lit, 1)).when(short, _expanded(tail)).when(kind == "blank", F.substring(tail, 3, 1 << 30)).when(kind == "uri", F.translate(tail, "<>", "")).otherwise(tail)
    return F.struct(kind.alias("kind"), unescaped(value).alias("value"), part(2).alias("lang"), _expanded(part(3)).alias("dtype"))
