"""Queries over every row, held against brute force on small tables."""

import hashlib
import random
import re
import string
import unicodedata

import pytest
from conftest import rows

import __spark_entry__ as E
from factlake.functions import similarity as S
from factlake.functions import text

Q = E.queries()
TERMS = [
    ("Q1", "en", "label", "Mill"), ("Q1", "en", "alias", "Mühl"), ("Q1", "en", "alias", "Miller"), ("Q1", "en", "alias", "Müll"), ("Q1", "en", "alias", "Mxxx"),
    ("Q2", "el", "label", "Λίμνη"), ("Q2", "el", "alias", "Λιμνη"), ("Q2", "el", "alias", "Λίμν"),
    ("Q3", "ru", "label", "Озеро"), ("Q3", "ru", "alias", "Озёра"), ("Q3", "en", "alias", "Lake"),
    ("Q4", "ja", "label", "富士山"), ("Q4", "ja", "alias", "富山"),
]


def put(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


def put_rest(spark, folder):
    """The tables that names come from beside wd_term, as far as a test doesn't write them: empty."""
    import os

    empty = {"wd_item": "id string, lid int, label string, kind string", "claims_ent": "head string, prop string, tail string", "wp_redirect": "src string, dst string, row_id bigint", "wp_wikidata": "title string, wikidata_id string, row_id bigint", "entity_dump": "line_no bigint, raw_line string"}
    for name, schema in empty.items():
        if not os.path.exists(f"{folder}/{name}.parquet"):
            put(spark, folder, name, [], schema)


def put_terms(spark, folder, terms):
    put(spark, folder, "wd_term", [(i, *t) for i, t in enumerate(terms, 1)], "term_id bigint, id string, lang string, kind string, text string")


def slow_levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pairs"))
    put_terms(spark, d, TERMS)
    labels = [t for t in TERMS if t[2] == "label"]
    return d, sorted({(l[3].lower(), a[3].lower()) for l in labels for a in TERMS if a[2] == "alias" and a[:2] == l[:2]})


def test_similarities_of_all_pairs(spark, pairs):
    d, p = pairs
    assert len(p) == 8 and sum(len(a) != len(b) for a, b in p) == 3
    assert rows(Q["dis_levenshtein"](spark, d)) == sorted(((a, b, slow_levenshtein(a, b)) for a, b in p), key=repr)
    assert rows(Q["dis_damerau"](spark, d)) == sorted(((a, b, S.damerau(a, b)) for a, b in p), key=repr)
    assert rows(Q["dis_hamming"](spark, d)) == sorted(((a, b, S.hamming(a, b)) for a, b in p), key=repr)
    assert rows(Q["sim_jaro"](spark, d)) == sorted(((a, b, round(S.jaro(a, b), 9), round(S.jaro_winkler(a, b), 9)) for a, b in p), key=repr)


def test_closest_of_all_pairs(spark, pairs):
    d, p = pairs
    want = {a: sorted((slow_levenshtein(a, b), abs(len(a) - len(b)), b) for x, b in p if x == a)[0][2] for a, _ in p}
    assert want["mill"] == "müll"  # of the ASCII aliases it would be miller
    assert dict(rows(Q["closest"](spark, d))) == want
    top = {(a, r + 1): b for a in want for r, (_, b) in enumerate(sorted((slow_levenshtein(a, b), b) for x, b in p if x == a)[:2])}
    assert {(r["a"], r["rank"]): r["b"] for r in Q["top_k_similar"](spark, d).collect()} == top


def plain_norm(t, punctuation):
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    t = re.sub(r"([A-Za-z])\1{2,}", r"\1\1", unicodedata.normalize("NFKC", t).lower())
    bare = "".join(c for c in t if c not in string.punctuation) if punctuation else ""
    return " ".join((bare if bare.strip() else t).split())


def test_normal_forms_are_composed(spark, tmp_path):
    d = str(tmp_path)
    terms = [("Q1", "en", "label", "Office Mill"), ("Q2", "en", "label", "Oﬃce  Ｍill"), ("Q3", "fr", "label", "Café (x)"), ("Q4", "fr", "alias", "Cafe\u0301 (x)"), ("Q5", "ja", "alias", "ﾘｾﾞ"), ("Q6", "ja", "label", "リゼ"), ("Q7", "en", "label", "Q12")]
    put_terms(spark, d, terms)
    put(spark, d, "documents", [(i, t[3]) for i, t in enumerate(terms)], "doc_id bigint, text string")
    put(spark, d, "wd_item", [(t[0], i, t[3], "item") for i, t in enumerate(terms)], "id string, lid int, label string, kind string")
    put(spark, d, "claims_ent", [("Q9", "P31", "Q2"), ("Q8", "P31", "Q2"), ("Q9", "P31", "Q1")], "head string, prop string, tail string")
    put_rest(spark, d)
    assert rows(Q["norm_text"](spark, d)) == [(i, hashlib.md5(plain_norm(t[3], False).encode()).hexdigest()) for i, t in enumerate(terms)]
    assert rows(Q["norm_query"](spark, d)) == [(i, plain_norm(t[3], False)) for i, t in enumerate(terms, 1)]
    vocab = {(i, scope, plain_norm(t, p)) for i, lang, _, t in terms if t != "Q12" for p in (False, True) for scope in ("en", "all")}  # main labels are English
    assert rows(Q["vocab_build"](spark, d)) == sorted(vocab, key=repr)
    known = sorted({v[2] for v in vocab})
    assert len(known) == 4  # each spelling has merged
    assert dict(rows(Q["label_lookup"](spark, d))) == {t[3]: known.index(plain_norm(t[3], False)) for t in terms[:6]}
    ranked = {(r["label"], r["id"]): (r["score"], r["rank"]) for r in Q["label_rank"](spark, d).collect()}
    assert ranked["office mill", "Q2"] == (2.0, 1) and ranked["office mill", "Q1"] == (1.0, 2) and len(ranked) == len({v[::2] for v in vocab})


def test_delete_index_of_the_vocabulary(spark, tmp_path):
    d = str(tmp_path)
    r = random.Random(1)
    base = ["".join(r.choices("abcde ф", k=r.randint(5, 14))).strip() + "x" for _ in range(40)]
    terms = [(f"Q{i}", "en" if i % 2 else "ru", "label" if i % 3 else "alias", t) for i, t in enumerate(base)]
    terms = [terms[i % 40] for i in range(250)]
    put_terms(spark, d, terms)
    put_rest(spark, d)
    vocab = {plain_norm(t, p) for t in base for p in (False, True)}
    edits = {(v, e) for v in vocab for e in text.delete_edits(v, 4, 10)}
    assert rows(Q["delete_edits"](spark, d)) == sorted(((v, len(e), hashlib.md5("|".join(sorted(e)).encode()).hexdigest()) for v in vocab if (e := text.delete_edits(v, 4, 10))), key=repr)
    index = {}
    for v, e in edits:
        index.setdefault(e, set()).add(v)
    sizes = {n: sorted(e for e, v in index.items() if len(v) == n) for n in {len(v) for v in index.values()}}
    assert rows(Q["delete_index"](spark, d)) == sorted(((n, len(e), e[0]) for n, e in sizes.items()), key=repr)
    typos = {(n := plain_norm(terms[i - 1][3], False))[:1] + n[2:] for i in (100, 200)}
    assert rows(Q["delete_posting"](spark, d)) == sorted(((t, v) for t in typos for v in index.get(t[:10], ())), key=repr)
    near = {(t, v): e for t in typos for v in vocab if (e := slow_levenshtein(t, v)) <= 2}
    assert near
    assert {(x["text"], x["label"]): round(x["score"], 9) for x in Q["fuzzy_search"](spark, d).collect()} == {(t, v): round(1 - e / max(len(t), len(v)), 9) for (t, v), e in near.items()}


def test_searches_ask_every_hundredth_term(spark, tmp_path):
    d = str(tmp_path)
    some = [("Q1", "en", "label", "Old Mill"), ("Q2", "ru", "label", "Старая мельница"), ("Q3", "el", "label", "Λίμνη Μύλος"), ("Q4", "en", "label", "Mill (Valley)")]
    terms = [some[i % 4] for i in range(400)]
    terms[99], terms[199], terms[299] = ("Q1", "en", "alias", "Mill"), ("Q2", "ru", "alias", "мельница"), ("Q4", "en", "alias", "Mils (Valley)")
    put_terms(spark, d, terms)
    put(spark, d, "claims_ent", [("Q1", "P31", "Q4"), ("Q2", "P31", "Q1")], "head string, prop string, tail string")
    put(spark, d, "wp_redirect", [("a", "b", 1)], "src string, dst string, row_id bigint")
    put(spark, d, "wp_wikidata", [("A", "Q1", 1)], "title string, wikidata_id string, row_id bigint")
    hits = lambda name: {(r["query"], r["doc"]) for r in Q[name](spark, d).collect()}
    put_rest(spark, d)
    exact = {(100, "Old Mill"), (100, "Mill (Valley)"), (200, "Старая мельница"), (300, "Mill (Valley)"), (400, "Old Mill"), (400, "Mill (Valley)")}
    assert hits("bm25_match") == hits("label_search") == exact
    assert hits("bm25_fuzzy") == exact | {(300, "Old Mill")}  # mils is one error from mill
    found = {(r["text"], r["id"]) for r in Q["entity_search"](spark, d).collect()}
    assert {("mll (valley)", "Q4"), ("mls (valley)", "Q4")} <= found and {i for _, i in found} <= {"Q1", "Q2", "Q3", "Q4"}


def test_pagerank_stats_are_converged(spark, tmp_path):
    d = str(tmp_path)
    edges = [("Q1", "Q2"), ("Q3", "Q2"), ("Q2", "Q4"), ("Q5", "Q4"), ("Q4", "Q6")]
    put(spark, d, "claims_ent", [(a, "P31", b) for a, b in edges], "head string, prop string, tail string")
    put(spark, d, "wp_redirect", [("a", "b", 1)], "src string, dst string, row_id bigint")
    put(spark, d, "wp_wikidata", [("A", "Q1", 1)], "title string, wikidata_id string, row_id bigint")
    nodes = sorted({x for e in edges for x in e})
    out = {x: [a for a, b in edges if b == x] for x in nodes}  # rank flows from tail to head
    x = dict.fromkeys(nodes, 1.0)
    for _ in range(300):
        rest = sum(x[v] * (0.15 if out[v] else 1) for v in nodes) / len(nodes)
        x = {v: rest + 0.85 * sum(x[u] / len(out[u]) for u in nodes if v in out[u]) for v in nodes}
    r = Q["pr_stats"](spark, d).first()
    assert r["n"] == 6 and abs(r["top"] - max(x.values())) < 1e-5 and abs(r["low"] - min(x.values())) < 1e-5


def test_numbers_that_are_both_0_are_alike(spark, tmp_path):
    put(spark, str(tmp_path), "lineitem", [(1, 1, 0.0, 0.0), (1, 2, 0.04, 0.08)], "l_orderkey bigint, l_linenumber int, l_discount double, l_tax double")
    assert rows(Q["sim_numeric"](spark, str(tmp_path))) == [(1, 1, 1.0), (1, 2, 0.5)]
