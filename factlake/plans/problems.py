"""Queries of the general data problems (p1, p2, p3, p6, p7) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.ids import plain_id, plain_title
from factlake.operators import hierarchy as H
from factlake.operators import nested, references, validation, widen
from factlake.sources.sql_dump import sql_tuples
from factlake.tables import table


#: The kinds of child that the result lists.
_CHILDREN_ASKED = ["label", "alias", "sitelink", "claim", "qualifier", "reference", "refsnak"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Children with a value, below parents with one; their keys and ordinals by level as k, pos, sub, k2, pos2."""
    bridge, objects = nested.shred(table(spark, d, "entity_dump"))
    c = nested.children(bridge.where(F.col("child").isin(_CHILDREN_ASKED)), objects)
    child, last = F.col("child"), F.size("ords") - 1
    below = child.isin("qualifier", "refsnak")
    return c.select(
        "line_no", "child", F.col("keys")[0].alias("k"), F.col("ords")[0].alias("pos"), F.when(child.isin("reference", "refsnak"), F.get("ords", F.lit(1))).otherwise(-1).alias("sub"),
        F.when(below, F.get("keys", last)).otherwise("").alias("k2"), F.when(below, F.get("ords", last)).otherwise(-1).alias("pos2"),
    )


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """Distinct objects and their occurrences per kind of child."""
    bridge, objects = nested.shred(table(spark, d, "entity_dump"))
    seen = bridge.groupBy("child").agg(F.count(F.lit(1)).alias("n_occurrences"))
    return objects.groupBy("child").agg(F.count(F.lit(1)).alias("n_objects")).join(seen, "child")


def _tree_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims_ent").where(F.col("prop").isin("P279", "P131"))
    return c.select("prop", plain_id(F.col("head")).alias("head"), plain_id(F.col("tail")).alias("tail"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_tree_links(spark, d), "prop", "head", "tail").select(F.col("g").alias("prop"), "node", "root", "depth", F.col("n_below").cast("int").alias("n_below"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every node that has a top, as text."""
    h = H.hierarchy(_tree_links(spark, d), "prop", "head", "tail", paths=True)
    return h.where("path is not null").select(F.col("g").alias("prop"), "node", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node below every node, with the number of links between them."""
    h = H.hierarchy(_tree_links(spark, d), "prop", "head", "tail", paths=True)
    return H.descendants(h).withColumnRenamed("g", "prop")


def p2_spare(spark: SparkSession, d: str) -> DataFrame:
    """Links that are in no tree because their node has a smaller parent, which is `kept`."""
    return H.spare_links(_tree_links(spark, d), "prop", "head", "tail").withColumnRenamed("g", "prop")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References as rows with a composite key: (ns, title) for pages, (item) for items, the other part null."""
    no = F.lit(None).cast("string")

    def refs(name: str, field: str, page: bool) -> DataFrame:
        c = F.col(field)
        key = [F.lit(0).alias("ns"), plain_title(c).alias("title"), no.alias("item")] if page else [F.lit(None).cast("int").alias("ns"), no.alias("title"), plain_id(c).alias("item")]
        return table(spark, d, name).where(c.isNotNull()).select(F.lit(name).alias("tab"), F.lit(field).alias("fld"), "row_id", "recorded_at", *key)

    all_refs = refs("wp_redirect", "src", True)
    for x in (("wp_redirect", "dst", True), ("wp_wikidata", "title", True), ("wp_wikidata", "wikidata_id", False), ("claims_ent", "tail", False)):
        all_refs = all_refs.unionByName(refs(*x))
    pages = table(spark, d, "wp_page").where("ns = 0").select("ns", plain_title(F.col("title")).alias("title"), no.alias("item"), "created_at", "deleted_at")
    items = table(spark, d, "wd_item").select(F.lit(None).cast("int").alias("ns"), no.alias("title"), plain_id(F.col("id")).alias("item"), "created_at", "deleted_at")
    return all_refs, pages.unionByName(items)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs, targets = _references(spark, d)
    return references.orphan_references(refs, targets, ["ns", "title", "item"], "recorded_at", "created_at", "deleted_at", match="partial")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tab", "fld", "row_id", F.date_format("recorded_at", "yyyy-MM").alias("period"), "reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d), "recorded_at", ["tab", "fld"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rules = validation.rule_table(spark)
    out = None
    for name, tuples in (("entity_dump", validation.entity_tuples(table(spark, d, "entity_dump"))), ("sql_dump", sql_tuples(table(spark, d, "sql_dump")))):
        bad = validation.rejected(tuples, rules).select(F.lit(name).alias("tab"), "line_no", "tuple_no", "reason")
        out = bad if out is None else out.unionByName(bad)
    return out


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows of both dumps, one row a cell."""
    rules = validation.rule_table(spark)
    out = None
    for name, tuples in (("entity_dump", validation.entity_tuples(table(spark, d, "entity_dump"))), ("sql_dump", sql_tuples(table(spark, d, "sql_dump")))):
        good = validation.load(tuples, rules)[0].select(F.lit(name).alias("tab"), "line_no", "tuple_no", "tbl", F.explode("row").alias("name", "value"))
        out = good if out is None else out.unionByName(good)
    return out


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return widen.sparse_deltas(table(spark, d, "dp_triple"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.filled_cells(widen.compact(_deltas(spark, d)))


def p7_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest value of every attribute of every head, of those that were written last."""
    return widen.compact(_deltas(spark, d), keep="latest").select("head", "prop", "dtype", F.when(F.col("dtype") == "quantity", F.col("value").cast("double")).alias("num"), F.when(F.col("dtype") != "quantity", F.col("value")).alias("txt"), F.col("version.row_id").alias("row_id"))


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per head, with a map of its attributes and their values for each type, written as JSON."""
    w = widen.wide(widen.compact(_deltas(spark, d)))
    return w.select("head", *[F.to_json(c).alias(c) for c in ("entity", "quantity", "time", "string")])


QUERIES = {f.__name__: f for f in (p1_found, p1_objects, p2_found, p2_paths, p2_descendants, p2_spare, p3_found, p3_report, p6_found, p6_loaded, p7_found, p7_latest, p7_wide)}

_LINKS = """links as (
  select prop, h as node, p as parent from (
    select prop, upper(trim(regexp_replace(head, '(?i)^\\s*http://kb\\.example/entity/', ''))) as h, upper(trim(regexp_replace(tail, '(?i)^\\s*http://kb\\.example/entity/', ''))) as p
    from claims_ent where prop in ('P279', 'P131') and head is not null and tail is not null)
  group by all),
nodes as (select prop, node from links union select prop, parent from links),
up as (
  select prop, node, node as anc, 0 as dist from nodes
  union
  select u.prop, u.node, l.parent, u.dist + 1 from up u join links l on l.prop = u.prop and l.node = u.anc where u.dist < 1000),
ends as (select u.prop, u.node, u.anc as root, u.dist as depth from up u where not exists (select 1 from links l where l.prop = u.prop and l.node = u.anc)),
below as (select prop, anc as node, count(distinct node) - 1 as n from up group by all)"""

_ORPHANS = """pages as (select distinct upper(title[1]) || replace(title[2:], '_', ' ') as k, created_at as c, deleted_at as d from wp_page where ns = 0),
items as (select distinct id as k, created_at as c, deleted_at as d from wd_item),
refs as (
  select 'wp_redirect' as tab, 'src' as fld, row_id, recorded_at as t, src as v, true as page from wp_redirect
  union all select 'wp_redirect', 'dst', row_id, recorded_at, dst, true from wp_redirect
  union all select 'wp_wikidata', 'title', row_id, recorded_at, title, true from wp_wikidata
  union all select 'wp_wikidata', 'wikidata_id', row_id, recorded_at, wikidata_id, false from wp_wikidata
  union all select 'claims_ent', 'tail', row_id, recorded_at, tail, false from claims_ent),
keyed as (
  select tab, fld, row_id, t, page, case when page then upper(trim(replace(v, '_', ' '))[1]) || trim(replace(v, '_', ' '))[2:]
    else upper(trim(regexp_replace(v, '(?i)^\\s*http://kb\\.example/entity/', ''))) end as k
  from refs where v is not null),
judged as (
  select r.tab, r.fld, r.row_id, strftime(r.t, '%Y-%m') as period,
    case when coalesce(p.k, i.k) is null then 'missing' when coalesce(p.c, i.c) > r.t then 'late' when coalesce(p.d, i.d) <= r.t then 'deleted' end as reason
  from keyed r left join pages p on r.page and p.k = r.k left join items i on not r.page and i.k = r.k)"""

_CHILDREN = r"""with raw as (select line_no, regexp_replace(trim(raw_line, ' ' || chr(9) || chr(10) || chr(13)), ',$', '') as l from entity_dump where raw_line is not null),
ok as (select line_no, l from raw where case when json_valid(l) and starts_with(l, '{') and not regexp_matches(l, ',\s*\}\s*$') then regexp_full_match(coalesce(case when json_type(l, '$.id') = 'VARCHAR' then json_extract_string(l, '$.id') end, ''), '[QqPp][0-9]+') else false end),
lab as (select line_no, 'label' as child, e.key as k, 0 as pos, -1 as sub, '' as k2, -1 as pos2 from ok, json_each(ok.l, '$.labels') e where json_type(ok.l, '$.labels') = 'OBJECT' and json_type(e.value) = 'OBJECT' and json_type(e.value, '$.value') <> 'NULL'),
sit as (select line_no, 'sitelink', e.key, 0, -1, '', -1 from ok, json_each(ok.l, '$.sitelinks') e where json_type(ok.l, '$.sitelinks') = 'OBJECT' and json_type(e.value) = 'OBJECT' and json_type(e.value, '$.title') <> 'NULL'),
alg as (select line_no, e.key as k, case json_type(e.value) when 'OBJECT' then json_array(e.value) else e.value end as v from ok, json_each(ok.l, '$.aliases') e where json_type(ok.l, '$.aliases') = 'OBJECT' and json_type(e.value) in ('OBJECT', 'ARRAY')),
ali as (select line_no, 'alias', k, cast(a.key as integer), -1, '', -1 from alg, json_each(alg.v) a where json_type(a.value) = 'OBJECT' and json_type(a.value, '$.value') <> 'NULL'),
clg as (select line_no, e.key as k, case json_type(e.value) when 'OBJECT' then json_array(e.value) else e.value end as v from ok, json_each(ok.l, '$.claims') e where json_type(ok.l, '$.claims') = 'OBJECT' and json_type(e.value) in ('OBJECT', 'ARRAY')),
cl as (select line_no, k, cast(a.key as integer) as pos, a.value as s from clg, json_each(clg.v) a where json_type(a.value) = 'OBJECT' and json_type(a.value, '$.mainsnak') = 'OBJECT' and json_type(a.value, '$.mainsnak.datavalue') <> 'NULL'),
qug as (select line_no, k, pos, e.key as k2, case json_type(e.value) when 'OBJECT' then json_array(e.value) else e.value end as v from cl, json_each(cl.s, '$.qualifiers') e where json_type(cl.s, '$.qualifiers') = 'OBJECT' and json_type(e.value) in ('OBJECT', 'ARRAY')),
qua as (select line_no, 'qualifier', k, pos, -1, k2, cast(a.key as integer) from qug, json_each(qug.v) a where json_type(a.value) = 'OBJECT' and json_type(a.value, '$.datavalue') <> 'NULL'),
rfg as (select line_no, k, pos, case json_type(s, '$.references') when 'OBJECT' then json_array(json_extract(s, '$.references')) else json_extract(s, '$.references') end as v from cl where json_type(s, '$.references') in ('OBJECT', 'ARRAY')),
rf as (select line_no, k, pos, cast(a.key as integer) as sub, a.value as r from rfg, json_each(rfg.v) a where json_type(a.value) = 'OBJECT'),
sng as (select line_no, k, pos, sub, e.key as k2, case json_type(e.value) when 'OBJECT' then json_array(e.value) else e.value end as v from rf, json_each(rf.r, '$.snaks') e where json_type(rf.r, '$.snaks') = 'OBJECT' and json_type(e.value) in ('OBJECT', 'ARRAY')),
sn as (select line_no, 'refsnak', k, pos, sub, k2, cast(a.key as integer) from sng, json_each(sng.v) a where json_type(a.value) = 'OBJECT' and json_type(a.value, '$.datavalue') <> 'NULL')
select * from lab union all select * from sit union all select * from ali union all select line_no, 'claim', k, pos, -1, '', -1 from cl union all select * from qua union all select line_no, 'reference', k, pos, sub, '', -1 from rf union all select * from sn"""

JUDGED = r"""with raw as (select line_no, trim(raw_line, ' ' || chr(9) || chr(10) || chr(13)) as t from entity_dump where raw_line is not null),
ent as (select line_no, regexp_replace(t, '\s*,$', '') as l from raw where t not in ('', '[', ']')),
jud as (select line_no, case when json_valid(l) and starts_with(l, '{') and not regexp_matches(l, ',\s*\}\s*$') then case when json_type(l, '$.id') = 'VARCHAR' and regexp_full_match(json_extract_string(l, '$.id'), '[QqPpLl][0-9]+') then null else 'id' end else 'json' end as reason from ent),
ins as (select line_no, regexp_extract(raw_line, '^\s*INSERT INTO `(\w+)` VALUES', 1) as tbl, regexp_extract(raw_line, '^\s*INSERT INTO `\w+` VALUES\s*(.*)$', 1) as v from sql_dump where regexp_matches(raw_line, '^\s*INSERT INTO `(page|redirect|page_props)` VALUES')),
quo as (select *, regexp_full_match(v, '(?:\((?:\s*(?:''(?:[^''\\]|\\.)*''|[^'',()]*)\s*)(?:,(?:\s*(?:''(?:[^''\\]|\\.)*''|[^'',()]*)\s*))*\)\s*,\s*)*\((?:\s*(?:''(?:[^''\\]|\\.)*''|[^'',()]*)\s*)(?:,(?:\s*(?:''(?:[^''\\]|\\.)*''|[^'',()]*)\s*))*\)\s*;?\s*') as fine from ins),
lst as (select line_no, tbl, regexp_extract_all(v, '\((?:\s*(?:''(?:[^''\\]|\\.)*''|[^'',()]*)\s*)(?:,(?:\s*(?:''(?:[^''\\]|\\.)*''|[^'',()]*)\s*))*\)') as ts from quo where fine),
tup as (select line_no, tbl, cast(unnest(range(1, len(ts) + 1)) as integer) as tuple_no, unnest(ts) as t from lst),
cel as (select line_no, tbl, tuple_no, list_transform(regexp_extract_all(t[2:length(t) - 1], '(?:^|,)(\s*(?:''(?:[^''\\]|\\.)*''|[^'',()]*)\s*)', 1), lambda x: trim(x)) as c from tup),
tst as (select line_no, tbl, tuple_no, len(c) = case tbl when 'page' then 6 when 'redirect' then 5 else 4 end as shape, c,
  list_transform(c, lambda x: case when starts_with(x, '''') then x[2:length(x) - 1] when upper(x) = 'NULL' then null else x end) as u from cel),
bad as (select line_no, tuple_no, shape, case when not shape then true else not coalesce(
  regexp_full_match(c[1], '[0-9]*[1-9][0-9]*') and case tbl
    when 'page' then regexp_full_match(c[2], '[0-9]+') and coalesce(u[3], '') <> '' and c[4] in ('0', '1') and regexp_full_match(c[5], '[0-9]+') and regexp_full_match(coalesce(u[6], ''), '[0-9]{14}') and try_strptime(u[6], '%Y%m%d%H%M%S') is not null
    when 'redirect' then regexp_full_match(c[2], '[0-9]+') and coalesce(u[3], '') <> ''
    else coalesce(u[2], '') <> '' and (u[2] <> 'wikibase_item' or regexp_full_match(coalesce(u[3], ''), '[Qq][0-9]+')) end, false) end as wrong from tst)"""

_REJECTED = JUDGED + r""" select 'entity_dump' as tab, line_no, 0 as tuple_no, reason from jud where reason is not null
union all select 'sql_dump', line_no, 0, 'quoting' from quo where not fine
union all select 'sql_dump', line_no, tuple_no, case when shape then 'value' else 'columns' end from bad where wrong"""

_LOADED = JUDGED + r""",
nam as (select 'page' as tbl, ['page_id', 'page_namespace', 'page_title', 'page_is_redirect', 'page_len', 'page_touched'] as ns union all select 'redirect', ['rd_from', 'rd_namespace', 'rd_title', 'rd_interwiki', 'rd_fragment'] union all select 'page_props', ['pp_page', 'pp_propname', 'pp_value', 'pp_sortkey']),
fin as (select t.line_no, t.tuple_no, t.tbl, unnest(n.ns) as name, unnest(t.u) as value from tst t join nam n using (tbl) where (t.line_no, t.tuple_no) in (select (line_no, tuple_no) from bad where not wrong))
select 'sql_dump' as tab, line_no, tuple_no, tbl, name, regexp_replace(value, '\\(.)', '\1', 'g') as value from fin
union all select 'entity_dump', j.line_no, 0, 'entity_dump', 'id', json_extract_string(e.l, '$.id') from jud j join ent e using (line_no) where j.reason is null"""

_CELLS = r"""t as (select row_id, loaded_at, trim(head) as h, trim(prop) as p, trim(tail) as t from dp_triple where head is not null and prop is not null and trim(tail) <> ''),
s as (select (upper(url_decode(regexp_replace(case when contains(h, '://') then regexp_extract(regexp_replace(h, '^<|>$', '', 'g'), '[^/#]*$') else h end, '_', ' ', 'g'))[1]) || url_decode(regexp_replace(case when contains(h, '://') then regexp_extract(regexp_replace(h, '^<|>$', '', 'g'), '[^/#]*$') else h end, '_', ' ', 'g'))[2:]) as head, case when contains(p, '://') then regexp_extract(regexp_replace(p, '^<|>$', '', 'g'), '[^/#]*$') else p end as p, t, row_id, loaded_at,
  regexp_full_match(t, '(?s)"(.*)"(?:@[A-Za-z0-9-]+|\^\^<?[^<>"\s]+>?)?') as lit, regexp_extract(t, '(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<?[^<>"\s]+>?)?$', 1) as x, regexp_extract(t, '\^\^<?(?:[^<>"\s]*[:/#])?([A-Za-z]+)>?$', 1) as d from t),
u as (select head, lower(p[1]) || p[2:] as prop, t, row_id, loaded_at, lit, d, replace(replace(parts[1] || coalesce(array_to_string(list_transform(parts[2:], lambda y: chr(cast('0x' || y[1:4] as integer)) || y[5:]), ''), ''), '\"', '"'), '\\', '\') as x from (select *, string_split(x, '\u') as parts from s)),
c as (select head, prop, row_id, loaded_at, case when not lit then 'entity'
    when d in ('integer', 'int', 'nonNegativeInteger') and regexp_full_match(x, '[+-]?[0-9]+') or d in ('double', 'decimal', 'float') and regexp_full_match(x, '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') then 'quantity'
    when d = 'gYear' and regexp_full_match(x, '-?[0-9]{4,}') or d = 'date' and regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(x as date) is not null or d = 'dateTime' and regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}') and try_cast(replace(x, 'T', ' ') as timestamp) is not null and x[12:13] < '24' then 'time'
    else 'string' end as dtype, t, x from u)"""

_TITLE = r"""(upper(url_decode(regexp_replace(case when contains(t, '://') then regexp_extract(regexp_replace(t, '^<|>$', '', 'g'), '[^/#]*$') else t end, '_', ' ', 'g'))[1]) || url_decode(regexp_replace(case when contains(t, '://') then regexp_extract(regexp_replace(t, '^<|>$', '', 'g'), '[^/#]*$') else t end, '_', ' ', 'g'))[2:])"""

ORACLE = {
    "p1_found": _CHILDREN,
    "p6_found": _REJECTED,
    "p6_loaded": _LOADED,
    "p7_found": f"with {_CELLS} select head, prop, dtype, cast(count(distinct case dtype when 'entity' then {_TITLE} when 'quantity' then cast(cast(x as double) as varchar) else x end) as integer) as n_values from c group by head, prop, dtype",
    "p7_latest": f"with {_CELLS} select head, prop, dtype, case when dtype = 'quantity' then cast(x as double) end as num, case dtype when 'entity' then {_TITLE} when 'quantity' then null else x end as txt, row_id from c qualify row_number() over (partition by head, prop order by loaded_at desc nulls last, row_id desc) = 1",
    "p2_found": f"with recursive {_LINKS} select n.prop, n.node, coalesce(e.root, '') as root, cast(coalesce(e.depth, -1) as integer) as depth, cast(case when e.root is null then -1 else b.n end as integer) as n_below from nodes n left join ends e on e.prop = n.prop and e.node = n.node join below b on b.prop = n.prop and b.node = n.node",
    "p2_paths": f"with recursive {_LINKS} select u.prop, u.node, string_agg(u.anc, '/' order by u.dist desc) as path from up u join ends e on e.prop = u.prop and e.node = u.node group by u.prop, u.node",
    "p2_descendants": f"with recursive {_LINKS} select u.prop, u.anc as ancestor, u.node, u.dist as distance from up u join ends e on e.prop = u.prop and e.node = u.node where u.dist > 0",
    "p2_spare": f"with recursive {_LINKS} select l.prop, l.node, l.parent, k.kept from links l join (select prop, node, min_by(parent, (length(parent), parent)) as kept from links group by prop, node) k on k.prop = l.prop and k.node = l.node where l.parent <> k.kept",
    "p3_found": f"with {_ORPHANS} select * from judged where reason is not null",
    "p3_report": f"with {_ORPHANS} select tab, fld, period, reason, count(*) as n_refs from judged where reason is not null group by all",
}
