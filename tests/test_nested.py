import json

import pytest
from conftest import rows

from factlake.operators import nested, validation
from factlake.plans import problems
from factlake.sources import entities, entity_json
from factlake.sources.entity_json import canonical, parse, read_entity
from factlake.sources.sql_dump import sql_tuples

V = {"datavalue": {"type": "string", "value": "v"}}
FULL = {
    "id": "Q1",
    "labels": {"en": {"value": "One"}, "de": {"value": None}, "fr": None},
    "aliases": {"en": [{"value": "I"}, None, {"value": "Uno"}], "es": {"value": "uno"}},
    "sitelinks": {"enwiki": {"title": "One"}, "dewiki": {"title": None}},
    "claims": {
        "P1": [{"mainsnak": {"datavalue": None}, "qualifiers": {"P9": [V]}}, {"mainsnak": V, "qualifiers": {"P2": [{"datavalue": None}, V]}, "references": [{"snaks": {"P3": [V, V]}}, {"snaks": {}}]}],
        "P4": {"mainsnak": V, "references": {"snaks": {"P5": V}}},
    },
}
WANT = [
    (1, "alias", "en", 0, -1, "", -1), (1, "alias", "en", 2, -1, "", -1), (1, "alias", "es", 0, -1, "", -1),
    (1, "claim", "P1", 1, -1, "", -1), (1, "claim", "P4", 0, -1, "", -1), (1, "label", "en", 0, -1, "", -1),
    (1, "qualifier", "P1", 1, -1, "P2", 1), (1, "reference", "P1", 1, 0, "", -1), (1, "reference", "P1", 1, 1, "", -1), (1, "reference", "P4", 0, 0, "", -1),
    (1, "refsnak", "P1", 1, 0, "P3", 0), (1, "refsnak", "P1", 1, 0, "P3", 1), (1, "refsnak", "P4", 0, 0, "P5", 0), (1, "sitelink", "enwiki", 0, -1, "", -1),
]


def lines(spark, raws):
    return spark.createDataFrame([(i, r, "x", b"h") for i, r in enumerate(raws, 1)], "line_no long, raw_line string, child string, hash binary")


def found(spark, raws, folder):
    lines(spark, raws).write.mode("overwrite").parquet(f"{folder}/entity_dump.parquet")
    return rows(problems.p1_found(spark, str(folder)))


def test_shapes(spark, tmp_path):
    assert found(spark, [json.dumps(FULL)], tmp_path) == sorted(WANT, key=repr)


def test_identity(spark):
    """Members in another order and other spacing are the same object; it is stored once, occurrences count each."""
    twisted = json.dumps(dict(reversed(FULL.items())), indent=1).replace("\n", " ")
    b, o = nested.shred(lines(spark, [json.dumps(FULL), "  " + twisted + " , ", json.dumps(FULL | {"id": "Q2"})]))
    assert b.where("child = 'entity'").select("hash").distinct().count() == 2
    assert b.where("child = 'claim'").count() == 9 and o.where("child = 'claim'").count() == 3
    assert o.where("child = 'refsnak'").count() == 1 and o.where("child = 'datavalue'").count() == 1
    # no occurrence is left out: qualifiers of a claim without a value are there, and every parent is
    assert b.where("child = 'qualifier'").count() == 9 and b.where("child = 'qualifier' and live").count() == 6
    known = {r.hash for r in b.collect()}
    assert all(r.parent in known for r in b.where("child <> 'entity'").collect())
    assert {r.hash for r in o.collect()} == known


def test_nothing_is_lost():
    """What is no object of its own stays in its parent's body, so that different records have different hashes."""
    base = {"id": "Q1", "labels": {"en": {"value": "x"}}, "aliases": {"en": [{"value": "y"}]}}
    variants = [base, base | {"more": {"deep": [1]}}, base | {"labels": {"en": {"value": "x", "note": None}}}, base | {"aliases": {"en": [None, {"value": "y"}]}}, base | {"aliases": {"en": [{"value": "y"}, "z"]}}, base | {"labels": {"en": "x"}}, base | {"claims": 3}]
    assert len({nested.identify(v)[0] for v in variants}) == len(variants)
    assert nested.identify(base)[0] == nested.identify(base | {"claims": {}, "sitelinks": None})[0]
    h, body, below = nested.identify({"id": "x", "a": [{"b": {"c": 1}}, {"b": {"c": 1}}]}, nested.Part("", "r", parts=(nested.Part("a", "a", many=True, parts=(nested.Part("b", "b"),)),)))
    assert [(r[0], r[1], r[2]) for r in below] == [("b", ("", ""), (0, 0)), ("b", ("", ""), (1, 0)), ("a", ("",), (0,)), ("a", ("",), (1,))] and len({r[3] for r in below}) == 2


def test_odd_lines(spark, tmp_path):
    raws = [None, "", " ", "[", "]", "{", '{"id": "L1", "labels": {"en": {"value": "x"}}}', '{"id": "q7", "labels": [], "claims": null, "aliases": 3, "sitelinks": "x"}', '{"id": "P1", "labels": {"a": {"value": ""}}}']
    assert found(spark, raws, tmp_path) == [(9, "label", "a", 0, -1, "", -1)]
    assert found(spark, [], tmp_path) == []
    deep = '{"id": "Q1", "labels": {"de": {"value": "d"}}, "x": ' + "[" * 100_000 + "]" * 100_000 + "}"
    long = json.dumps({"id": "Q1", "labels": {"en": {"value": "y" * 300_000}}})
    assert found(spark, [deep, long, '{"id": "Q1", "labels": {"\\ud800": {"value": "d"}}}'], tmp_path) == [(1, "label", "de", 0, -1, "", -1), (2, "label", "en", 0, -1, "", -1), (3, "label", "?", 0, -1, "", -1)]


def test_deep_json():
    """The reader with its own stack agrees with the usual one, on good and broken texts."""
    good = ['{}', '[]', '[[], {}]', ' {"a": [1, -2.5e3, "x\\u00e9\\n", true, null, {"b": {}}], "a": 2} ', '"x"', "0", '[{"a": 1}, {"b": [2, 3]}]']
    for t in good:
        assert entity_json._parse_deep(t) == json.loads(t) and entity_json._canonical_deep(json.loads(t)) == canonical(json.loads(t))
    for t in ["", "{", "[", "]", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "[1 2]", "{]", "[}", "01", "NaN", "'x'", '"\n"', "[1]]", "{} {}", '{"a" 1}', "1:", "[:]", '{"a":1 "b":2}', "-", "[1,,2]"]:
        with pytest.raises(ValueError):
            entity_json._parse_deep(t)
        with pytest.raises(ValueError):
            parse(t)
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    assert canonical(parse(deep)) == deep
    with pytest.raises(ValueError):
        parse(deep[:-1])
    assert canonical(parse('{"n": ' + "9" * 5000 + "}")) != canonical(parse('{"n": "' + "9" * 5000 + '"}'))


def test_rejected(spark):
    raws = [None, "[", '{"id": "Q1"},', '{"id": "Q1"},,', '{"id": "Q1"} {"id": "Q2"}', '{"id": 5}', "{}", '{"id": "Q1a"}', '{"id": "Q"}', "[1]", '{"id": "Q1", "n": NaN}', '{"id": "l33"}', '{"id": "Q１"}', '{"id": "Q1", "n": ' + "9" * 5000 + "}"]
    raws.append('{"id": "Q1", "x": ' + "[" * 20_000 + "]" * 20_000 + "}")
    rules = validation.rule_table(spark)
    bad = lambda r: validation.rejected(validation.entity_tuples(lines(spark, r)), rules).select("line_no", "reason")
    assert sorted(rows(bad(raws))) == [(4, "json"), (5, "json"), (6, "id"), (7, "id"), (8, "id"), (9, "id"), (10, "json"), (11, "json"), (13, "id")]
    assert rows(bad([])) == []
    good, _ = validation.load(validation.entity_tuples(lines(spark, raws)), rules)
    assert [(r.line_no, r.row["id"]) for r in good.orderBy("line_no").collect()] == [(3, "Q1"), (12, "l33"), (14, "Q1"), (15, "Q1")]


def test_same_judgement():
    """The rule table and the reader agree on ids."""
    assert read_entity('{"id": "Q12"}')[1] is None and read_entity('{"id": "Q 12"}')[1] == "id"


SQL = [
    ("INSERT INTO `page` VALUES (1,0,'A',0,10,'20200229010203'),(2,0,'B',0,10,'20190229010203');", [(2, "value")]),
    ("INSERT INTO `page` VALUES (1,0,'A',0,10);", [(1, "columns")]),
    ("INSERT INTO `page` VALUES (0,0,'A',0,10,'20200229010203'),('1',0,'A',0,10,'20200229010203'),(1,-1,'A',0,10,'20200229010203'),(1,0,NULL,0,10,'20200229010203'),(1,0,'',2,10,'20200229010203'),(1,0,'A',0,NULL,'20200229010203');", [(i, "value") for i in range(1, 7)]),
    ("INSERT INTO `page` VALUES (1,0,'Dam' b',0,10,'20200229010203');", [(0, "quoting")]),
    ("INSERT INTO `page` VALUES (1,0,A',0,10,'20200229010203');", [(0, "quoting")]),
    ("INSERT INTO `page` VALUES (1,0,'A,0,10,'20200229010203');", [(0, "quoting")]),
    (r"INSERT INTO `page` VALUES (1, 0, 'O\'A (x), \\', 1, 10, '20200229010203') , (2,0,'B;',0,1,20200101000000);", []),
    ("INSERT INTO `redirect` VALUES (1,0,'A',NULL,''),(1e3,0,'A',NULL,''),(5,0,'A','','',1);", [(2, "value"), (3, "columns")]),
    ("INSERT INTO `page_props` VALUES (1,'wikibase_item','q5',NULL),(1,'wikibase_item','5',0.5),(1,'other','5',0.5),(1,'','5',0.5),(1,'wikibase_item',NULL,17);", [(2, "value"), (4, "value"), (5, "value")]),
    ("-- INSERT INTO page", []), ("", []), (None, []), ("DROP TABLE page;", []), ("INSERT INTO `other` VALUES (1);", []), ("INSERT INTO `page` VALUES ();", [(1, "columns")]),
]


def test_sql(spark):
    df = spark.createDataFrame([(i, r, "x") for i, (r, _) in enumerate(SQL)], "line_no long, raw_line string, tbl string")
    rules = validation.rule_table(spark)
    bad = validation.rejected(sql_tuples(df), rules)
    assert rows(bad.select("line_no", "tuple_no", "reason")) == sorted(((i, t, r) for i, (_, w) in enumerate(SQL) for t, r in w), key=repr)
    good, bad2 = validation.load(sql_tuples(df), rules)
    assert good.count() == 1 + 2 + 1 + 2 and bad2.count() == bad.count()
    assert good.where("line_no = 6 and tuple_no = 1").first().row["page_title"] == "O'A (x), \\"
    assert rows(validation.rejected(sql_tuples(df.where("false")), rules)) == []


def test_long_line(spark):
    big = "INSERT INTO `redirect` VALUES " + ",".join(f"({i + 1},0,'T{i}',NULL,'')" for i in range(20_000)) + ";"
    t = sql_tuples(spark.createDataFrame([(1, big)], "line_no long, raw_line string"))
    assert t.count() == 20_000 and validation.rejected(t, validation.rule_table(spark)).count() == 0


def test_typed_claims(spark):
    e = {"id": "q9", "claims": {"P1": [{"mainsnak": {"datavalue": {"type": t, "value": v}}} for t, v in (("time", {"time": "+1990-00-00T00:00:00Z"}), ("time", {"time": "-0044-03-15T00:00:00Z"}), ("quantity", {"amount": "+5", "unit": "1"}), ("quantity", {"amount": "-2.5", "unit": "http://kb.example/entity/Q66"}), ("wikibase-entityid", {"numeric-id": 7}), ("monolingualtext", {"text": "t", "language": "en"}), ("string", "s"), ("globecoordinate", {"latitude": 1}))]}}
    got = entities.read_entities(lines(spark, [json.dumps(e)] * 2)).where("part = 'claim'").select("dtype", "value", "unit")
    assert rows(got) == sorted([("time", "1990-00-00", None), ("time", "-0044-03-15", None), ("quantity", "5", "-1"), ("quantity", "-2.5", "Q66"), ("entity", "Q7", None), ("string", "t", None), ("string", "s", None), ("other", '{"latitude":1}', None)], key=repr)
