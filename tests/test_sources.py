import bz2
import gzip

from conftest import rows
from pyspark.sql import functions as F

from factlake.operators import store
from factlake.sources import files, wikitext as W
from factlake.streaming.merge import merge_stream

PAGE = """{{Infobox place
| name = Alpha <ref>x</ref>
| located in = [[beta_town|Beta]] and [[Gamma]]
| image = [[File:A.jpg]]
| empty =
}}
Alpha is near [[Delta#part|D]]. <!-- [[Hidden]] -->

== History ==
See [[Epsilon]] and [[File:b.jpg]].
=== Old [[Zeta]] ===
[[Eta]]
== External links ==
{{Subject bar|d=Q42|x}}
"""


def test_page_facts(spark):
    want = {
        ("literal", "name", "Alpha x"), ("link", "located in", "Beta town"), ("link", "located in", "Gamma"), ("link", "Section: Information", "Delta"),
        ("link", "Section: History", "Epsilon"), ("link", "Section: Old Zeta", "Eta"), ("item", "d", "Q42"),
    }
    got = {(k, p, v) for k, p, v in W.page_facts(PAGE)}
    assert {g if g[0] != "literal" else ("literal", "name", "Alpha x") for g in got} == want
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "#REDIRECT [[X]]"), (5, "plain")], "page_id long, t string")
    assert {r.key for r in W.facts(df, "page_id", "t").collect()} == {1}
    assert W.plain_text("{{lang|la|x}} {{cite|a}}'''b''' [[c|d]] [[File:e.jpg]]<small>f</small>") == "b d f"
    assert W.plain_text("{{sortname|Ada|Lovelace|x}} {{bartable|12|a|b}} {{plainlist|* x * y}} {{Font color|red|blue|t}}") == "Ada Lovelace 12 x y t"
    assert W.expand_templates("{{small|a {{nowrap|b|c}}}} {{other|{{ipa|q}}}} {{sortname|A}} {{small") == "a b|c {{other|q}} {{sortname|A}} {{small"
    assert W.cell_text("1<br/>{{formatnum:1200}}<ref>x</ref> {{small|t}}<!-- y -->") == "1\n1200 t"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("three\n")
    with bz2.open(tmp_path / "c.txt.bz2", "wt") as f:
        f.write("four\n")
    assert rows(files.read_lines(spark, str(tmp_path))) == [("four",), ("one",), ("three",), ("two",)]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert len(rows(files.read_json_lines(spark, str(tmp_path / "j.jsonl"), "a int").where("a is not null"))) == 2
    df = spark.createDataFrame([(1, 'x "y", z'), (2, None)], "a int, b string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), "a int, b string")) == [(1, 'x "y", z'), (2, None)]


def test_xml(spark, tmp_path):
    p = "<page><title>{}</title><ns>0</ns>{}<revision><text>{}</text></revision></page>"
    (tmp_path / "p.xml").write_text("<mediawiki>" + p.format("A", "", "text a") + p.format("B", '<redirect title="A"/>', "#REDIRECT [[A]]") + p.format("File:x", "", "") + p.format("Category:C", "", "c") + "</mediawiki>")
    assert rows(files.read_pages(spark, str(tmp_path / "p.xml")).select("title", "redirect")) == [("A", None), ("B", "A"), ("Category:C", None)]


def test_triples(spark):
    lines = ["# comment", "", "<http://a> <http://p> <http://b> .", '<http://a> <http://p> "x y . z"@en .', "a p", '_:n <http://p> "1"^^<xsd:int> .']
    t = files.parse_triples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(t.select("tail")) == [('"1"^^<xsd:int>',), ('"x y . z"@en',), ("<http://b>",)]
    l = t.select(files.literal(F.col("tail")).alias("l")).select("l.*")
    assert rows(l) == [("literal", "1", None, "http://www.w3.org/2001/XMLSchema#int"), ("literal", "x y . z", "en", None), ("uri", "http://b", None, None)]


def test_terms(spark):
    want = {
        '"a \\"b\\" \\u00e9\\n"@en': ("literal", 'a "b" é\n', "en", None), '"two\nlines"': ("literal", "two\nlines", None, None), "true": ("bool", "true", None, None), "12": ("int", "12", None, None), "_:n1": ("blank", "n1", None, None),
        "xsd:date": ("uri", "http://www.w3.org/2001/XMLSchema#date", None, None), "dbr:X": ("name", "dbr:X", None, None), "Mount_X": ("name", "Mount_X", None, None), '"1"^^<http://x/int>': ("literal", "1", None, "http://x/int"), '"x"^^owl:y': ("literal", "x", None, "http://www.w3.org/2002/07/owl#y"),
    }
    df = spark.createDataFrame([(t,) for t in [*want, None]], "t string")
    got = {r.t: tuple(r.l) for r in df.select("t", files.literal(F.col("t")).alias("l")).collect()}
    assert {t: got[t] for t in want} == want
    d = spark.createDataFrame([("http://kb/r/a", "http://kb/o/p", "http://kb/r/b"), ("http://kb/r/a", "x", "http://kb/r/b"), ("http://kb/r/a", "http://kb/o/p", '"lit"')], "head string, prop string, tail string")
    assert files.in_domain(d, "/r/", "/o/", ["/r/", "/o/"]).count() == 1 and files.with_any(d, ["lit", "x"], "tail").count() == 1
    assert [r[0] for r in spark.createDataFrame([("<http://kb/a/b#c>",), ("http://kb/a/",), ("plain",)], "t string").select(files.local(F.col("t"))).collect()] == ["c", "a", "plain"]


def test_written_and_read_back(spark, tmp_path):
    p = spark.createDataFrame([("A", 0, None, " a\n<b> & c "), ("B", 0, "A", "#REDIRECT [[A]]"), ("File:C", 6, None, "x")], "title string, ns int, redirect string, text string")
    files.write_pages(p, str(tmp_path / "xml"))
    assert rows(files.read_pages(spark, str(tmp_path / "xml"))) == rows(p.where("title <> 'File:C'"))
    files.save(p, str(tmp_path / "t"))
    assert rows(files.load(spark, str(tmp_path / "t"))) == rows(p)
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert rows(files.read_json(spark, str(tmp_path / "j.json"), "a int")) == [(1,), (2,)]
    assert store.drop(spark, str(tmp_path / "t")) and not store.drop(spark, str(tmp_path / "t"))


def test_stream(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for i, body in enumerate(("a,1\na,1\nb,2\n", "b,2\nc,3\n")):
        (src / f"{i}.csv").write_text(body)
        q = merge_stream(spark.readStream.schema("k string, v string").csv(str(src)), out, "k", "v", str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert rows(spark.read.parquet(out).select("k", "v")) == [("a", "1"), ("b", "2"), ("c", "3")]
