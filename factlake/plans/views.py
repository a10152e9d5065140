"""The knowledge graph as views over the input tables, for Spark, and the same as SQL for the check."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import text
from factlake.functions.ids import plain_id, plain_title
from factlake.operators import store
from factlake.sources import entities
from factlake.tables import table


def claims(spark: SparkSession, d: str) -> DataFrame:
    """(head, prop, tail), plain and distinct; rows with a null are left out."""
    c = table(spark, d, "claims_ent").select(plain_id(F.col("head")).alias("head"), "prop", plain_id(F.col("tail")).alias("tail"))
    return c.dropna().distinct()


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wd_item").select("id", "lid", "label", "kind").distinct()


def terms(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(id, lang, label): labels or aliases with a text."""
    t = table(spark, d, "wd_term").where((F.col("kind") == kind) & (F.col("text") != ""))
    return t.select(plain_id(F.col("id")).alias("id"), "lang", F.col("text").alias("label")).distinct()


def redirects(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): plain titles, the last row of a source wins, self-redirects left out."""
    r = table(spark, d, "wp_redirect").select(plain_title(F.col("src")).alias("src"), plain_title(F.col("dst")).alias("dst"), "row_id").dropna()
    return store.last_wins(r.where("src <> dst"), "src", "dst", ["row_id"])


def page_items(spark: SparkSession, d: str) -> DataFrame:
    """(title, item): page title to item; of several the smallest."""
    m = table(spark, d, "wp_wikidata").select(plain_title(F.col("title")).alias("title"), plain_id(F.col("wikidata_id")).alias("item")).dropna()
    return m.groupBy("title").agg(F.min("item").alias("item"))


#: Properties whose values are names of the item.
NAME_PROPS = (
    "P528", "P3083", "P3382", "P742", "P1845", "P8338", "P5168", "P1449", "P4970", "P2561", "P1448", "P1813",
    "P1843", "P1476", "P735", "P1533", "P1950", "P8253", "P960", "P9382", "P4633",
)
#: Fixed value: the class of people.
HUMAN = "Q5"


def entity_claims(spark: SparkSession, d: str) -> DataFrame:
    """(id, prop, dtype, value, unit): typed claims of the entity dump."""
    return entities.read_entities(table(spark, d, "entity_dump")).where("part = 'claim'").select("id", F.col("k").alias("prop"), "dtype", "value", "unit")


def names(spark: SparkSession, d: str) -> DataFrame:
    """(id, scope, label): every name an item goes by, from all sources; scope en for English ones, which are in all too.

    Main label and, for people, its abbreviation; labels and aliases of all languages; values of name properties, but for
    all digits, English where they are ASCII; the page's title and the titles that redirect to it.
    """
    main = items(spark, d).where("label is not null").select("id", "label")
    people = claims(spark, d).where((F.col("prop") == "P31") & (F.col("tail") == HUMAN)).select(F.col("head").alias("id")).distinct()
    short = main.join(people, "id", "left_semi").select("id", text.abbreviate(F.col("label")).alias("label")).where("label is not null")
    pages = page_items(spark, d)
    lead = redirects(spark, d).join(pages, F.col("dst") == F.col("title")).select(F.col("item").alias("id"), F.col("src").alias("label"))
    en = main.unionByName(short).unionByName(pages.select(F.col("item").alias("id"), F.col("title").alias("label"))).unionByName(lead)
    told = entity_claims(spark, d).where((F.col("dtype") == "string") & F.col("prop").isin(*NAME_PROPS) & ~F.col("value").rlike("^[0-9]+$"))
    told = told.select("id", F.when(text.is_ascii(F.col("value")), "en").otherwise("all").alias("scope"), F.col("value").alias("label"))
    both = terms(spark, d, "label").unionByName(terms(spark, d, "alias")).select("id", F.when(F.col("lang") == "en", "en").otherwise("all").alias("scope"), "label")
    every = both.unionByName(told).unionByName(en.select("id", F.lit("en").alias("scope"), "label"))
    return every.select("id", F.explode(F.when(F.col("scope") == "en", F.array(F.lit("en"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("scope"), "label")


def literals(spark: SparkSession, d: str) -> DataFrame:
    """(id, prop, dtype, num, txt) of customers, suppliers, parts and orders."""
    no_num, no_txt = F.lit(None).cast("double"), F.lit(None).cast("string")
    out = None
    for name, key, letter, cols in (("customer", "c_custkey", "C", {"c_acctbal": "quantity", "c_name": "string", "c_mktsegment": "string"}), ("supplier", "s_suppkey", "S", {"s_acctbal": "quantity", "s_name": "string"}), ("part", "p_partkey", "A", {"p_retailprice": "quantity", "p_name": "string"}), ("orders", "o_orderkey", "O", {"o_totalprice": "quantity", "o_orderdate": "time"})):
        t = table(spark, d, name)
        for c, kind in cols.items():
            num = F.col(c) if kind == "quantity" else no_num
            txt = no_txt if kind == "quantity" else F.date_format(c, "yyyy-MM-dd") if kind == "time" else F.col(c)
            part = t.select(F.concat(F.lit(letter), key).alias("id"), F.lit(c).alias("prop"), F.lit(kind).alias("dtype"), num.alias("num"), txt.alias("txt"))
            out = part if out is None else out.unionByName(part)
    return out


def sql_id(x: str) -> str:
    return f"upper(trim(regexp_replace({x}, '(?i)^\\s*http://kb\\.example/entity/', '')))"


def sql_title(x: str) -> str:
    t = f"trim(replace({x}, '_', ' '))"
    return f"(upper(({t})[1]) || ({t})[2:])"


def _compatibility() -> tuple[str, str]:
    """(class, map) for SQL, which has no NFKC: the characters with a compatibility mapping, and that mapping, by rule."""
    every = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]
    pairs = [(c, k) for c in every if (k := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c)]
    ranges: list[list[int]] = []
    for c, _ in pairs:
        if ranges and ord(c) == ranges[-1][1] + 1:
            ranges[-1][1] = ord(c)
        else:
            ranges.append([ord(c), ord(c)])
    lists = [", ".join("'" + x.replace("'", "''") + "'" for x in side) for side in zip(*pairs)]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]", f"map([{lists[0]}], [{lists[1]}])"


_CLASS, _MAP = _compatibility()


def sql_nfkc(x: str) -> str:
    """x without format characters, in compatibility normalisation composed form."""
    t = f"regexp_replace({x}, '\\p{{Cf}}', '', 'g')"
    return f"case when regexp_matches({x}, '{_CLASS}') then nfc_normalize(array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda c: coalesce({_MAP}[c], c)), '')) else nfc_normalize({t}) end"


_LITERALS = " union all ".join(
    f"select '{letter}' || {key} as id, '{c}' as prop, '{kind}' as dtype, {f'cast({c} as double)' if kind == 'quantity' else 'cast(null as double)'} as num, {'cast(null as varchar)' if kind == 'quantity' else f'''strftime({c}, '%Y-%m-%d')''' if kind == 'time' else c} as txt from {name}"
    for name, key, letter, cols in (("customer", "c_custkey", "C", {"c_acctbal": "quantity", "c_name": "string", "c_mktsegment": "string"}), ("supplier", "s_suppkey", "S", {"s_acctbal": "quantity", "s_name": "string"}), ("part", "p_partkey", "A", {"p_retailprice": "quantity", "p_name": "string"}), ("orders", "o_orderkey", "O", {"o_totalprice": "quantity", "o_orderdate": "time"}))
    for c, kind in cols.items()
)

#: Lines of the entity dump that load and are items or properties, as (l).
_OK = r"""select l from (select regexp_replace(trim(raw_line, ' ' || chr(9) || chr(10) || chr(13)), ',$', '') as l from entity_dump where raw_line is not null)
            where case when json_valid(l) and starts_with(l, '{') and not regexp_matches(l, ',\s*\}\s*$') then regexp_full_match(coalesce(case when json_type(l, '$.id') = 'VARCHAR' then json_extract_string(l, '$.id') end, ''), '[QqPp][0-9]+') else false end"""

_SQL = {
    "cl": f"select distinct {sql_id('head')} as head, prop, {sql_id('tail')} as tail from claims_ent where head is not null and tail is not null and prop is not null",
    "it": "select distinct id, lid, label, kind from wd_item",
    "lb": f"select distinct {sql_id('id')} as id, lang, text as label from wd_term where kind = 'label' and text <> ''",
    "al": f"select distinct {sql_id('id')} as id, lang, text as label from wd_term where kind = 'alias' and text <> ''",
    "rd": f"select src, max_by(dst, row_id) as dst from (select {sql_title('src')} as src, {sql_title('dst')} as dst, row_id from wp_redirect where src is not null and dst is not null) where src <> dst group by src",
    "xm": f"select title, min(item) as item from (select {sql_title('title')} as title, {sql_id('wikidata_id')} as item from wp_wikidata where title is not null and wikidata_id is not null) group by title",
    "lit": _LITERALS,
    "ec": r"""select distinct id, prop, case type when 'wikibase-entityid' then 'entity' when 'time' then 'time' when 'quantity' then 'quantity' when 'monolingualtext' then 'string' when 'string' then 'string' else case json_type(v) when 'VARCHAR' then 'string' else 'other' end end as dtype, type,
      case type when 'wikibase-entityid' then coalesce(json_extract_string(v, '$.id'), 'Q' || json_extract_string(v, '$.numeric-id')) when 'time' then regexp_replace(regexp_replace(json_extract_string(v, '$.time'), '^\+', ''), 'T00:00:00Z$', '') when 'quantity' then regexp_replace(json_extract_string(v, '$.amount'), '^\+', '') when 'monolingualtext' then json_extract_string(v, '$.text') else json_extract_string(v, '$') end as value,
      case when type = 'quantity' then case coalesce(json_extract_string(v, '$.unit'), '1') when '1' then '-1' else regexp_extract(json_extract_string(v, '$.unit'), '[^/]*$') end end as unit
      from (select id, prop, json_extract_string(s, '$.mainsnak.datavalue.type') as type, json_extract(s, '$.mainsnak.datavalue.value') as v from (
        select id, prop, unnest(from_json(case json_type(g) when 'OBJECT' then json_array(g) else g end, '["json"]')) as s from (
          select upper(json_extract_string(o.l, '$.id')) as id, e.key as prop, e.value as g from (@OK) o,
          json_each(o.l, '$.claims') e where json_type(o.l, '$.claims') = 'OBJECT' and json_type(e.value) in ('OBJECT', 'ARRAY')))
        where json_type(s) = 'OBJECT' and json_type(s, '$.mainsnak') = 'OBJECT' and json_type(s, '$.mainsnak.datavalue') = 'OBJECT')""",
    "ea": r"""select distinct id, part, k, value from (
      select upper(json_extract_string(o.l, '$.id')) as id, 'label' as part, e.key as k, json_extract_string(e.value, '$.value') as value from (@OK) o, json_each(o.l, '$.labels') e where json_type(o.l, '$.labels') = 'OBJECT' and json_type(e.value) = 'OBJECT'
      union all select upper(json_extract_string(o.l, '$.id')), 'description', e.key, json_extract_string(e.value, '$.value') from (@OK) o, json_each(o.l, '$.descriptions') e where json_type(o.l, '$.descriptions') = 'OBJECT' and json_type(e.value) = 'OBJECT'
      union all select upper(json_extract_string(o.l, '$.id')), 'sitelink', e.key, json_extract_string(e.value, '$.title') from (@OK) o, json_each(o.l, '$.sitelinks') e where json_type(o.l, '$.sitelinks') = 'OBJECT' and json_type(e.value) = 'OBJECT'
      union all select id, 'alias', k, json_extract_string(s, '$.value') from (select upper(json_extract_string(o.l, '$.id')) as id, e.key as k, unnest(from_json(case json_type(e.value) when 'OBJECT' then json_array(e.value) else e.value end, '["json"]')) as s from (@OK) o, json_each(o.l, '$.aliases') e where json_type(o.l, '$.aliases') = 'OBJECT' and json_type(e.value) in ('OBJECT', 'ARRAY')) where json_type(s) = 'OBJECT')
      where value is not null""",
    "nm": f"""select id, unnest(case when scope = 'en' then ['en', 'all'] else ['all'] end) as scope, label from (
      select id, case when lang = 'en' then 'en' else 'all' end as scope, label from lb union all select id, case when lang = 'en' then 'en' else 'all' end, label from al
      union all select id, 'en', label from it where label is not null
      union all select id, 'en', label[1] || '. ' || array_to_string(string_split_regex(label, '\\s+')[2:], ' ') from it where regexp_matches(label, '\\s') and id in (select head from cl where prop = 'P31' and tail = '{HUMAN}')
      union all select item, 'en', title from xm union all select x.item, 'en', r.src from rd r join xm x on x.title = r.dst
      union all select id, case when regexp_full_match(value, '[\\x00-\\x7F]*') then 'en' else 'all' end, value from ec where dtype = 'string' and prop in {NAME_PROPS} and not regexp_full_match(value, '[0-9]+'))""",
}


def sql(names: str, query: str, more: str = "", recursive: bool = False) -> str:
    """SQL with the views named (separated by spaces), further named queries, and the query itself."""
    parts = [f"{n} as ({_SQL[n].replace('@OK', _OK)})" for n in names.split()]
    return f"with {'recursive ' if recursive else ''}{', '.join([*parts, *([more] if more else [])])} {query}" if parts or more else query
