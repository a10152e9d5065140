import random
import unicodedata

import pytest

from factlake.llm import leakage, lookalike, markup as M, mojibake, tokens


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- look-alikes ---


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Mount", "Ｍｏｕｎｔ"), ("Mount A", "Mount A"), ("Mount A", "Mount　A​"), ("Mount", " Mo­unt﻿"), ("é", "é"), ("fire", "ﬁre"),
        ("Kop", "Кор"), ("Kop", "Κοp"), ("a-b", "a‑b"), ("a-b", "a‐b"), ("ガ", "ｶﾞ"), ("ガ", "カ​゙"), ("é", "е́"), ("II", "ΙΙ"), ("", "​ "),
    ],
)
def test_look_the_same(a, b):
    assert a != b and lookalike.look(a) == lookalike.look(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("a-b", "a–b"), ("a b", "ab"), ("a.", "a"), ("O", "0"), ("l", "1"), ("l", "I"), ("x2", "x²"), ("1", "①"), ("rn", "m"), ("З", "3")])
def test_look_different(a, b):
    assert lookalike.look(a) != lookalike.look(b)


def test_fold():
    assert lookalike.look("Straße Ａ", fold=True) == lookalike.look("STRASSE a", fold=True)
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(chr(rnd.choice((rnd.randrange(32, 0x250), rnd.randrange(0x370, 0x530), rnd.randrange(0x2000, 0x2100), rnd.randrange(0x3040, 0x3100), rnd.randrange(0xFF00, 0xFFEF)))) for _ in range(12))
        assert lookalike.look(lookalike.look(t)) == lookalike.look(t)
        assert lookalike.look(unicodedata.normalize("NFD", t)) == lookalike.look(t)


def test_pairs(spark):
    data = [(1, "en", "Ab"), (2, "en", "Аb"), (3, "de", "Ab"), (4, "en", "Ab"), (5, "en", "ab"), (6, "en", None), (7, "en", ""), (8, "en", "​"), (9, None, "Ab"), (10, None, "Аb"), (11, "en", "x" * 200_000), (12, "en", "x" * 199_999 + "х")]
    df = spark.createDataFrame([(*d, "k", "f") for d in data + data[:2]], "term_id long, lang string, text string, key string, form string")
    assert rows(lookalike.alike_pairs(df, "term_id", "lang", "text")) == [(1, 2), (11, 12), (2, 4), (7, 8), (9, 10)]
    assert rows(lookalike.alike_pairs(df.where("false"), "term_id", "lang", "text")) == []


def test_many_equal_texts(spark):
    """Rows of one text never meet: 3,000 equal ones and two that look the same give 2 x 3,000 pairs and one."""
    df = spark.range(3_000).selectExpr("id", "'en' as lang", "'Kop' as text").union(spark.createDataFrame([(5_000, "en", "Кop"), (5_001, "en", "Коp")], "id long, lang string, text string"))
    got = lookalike.alike_pairs(df, "id", "lang", "text")
    assert got.count() == 6_001 and got.where("key_a = 5000").count() == 1


# --- markup ---

CORPUS = ["The lake covers 12 hectares between two old hills. A mill stands near the northern bridge since 1402.\n\nRecords kept by the abbey list four sites. The village lost its market after the great flood."] * 3
WEIGHTS = M.train(CORPUS)


def count(text):
    out = {}
    for k, _ in M.elements(M.parse(text, WEIGHTS)):
        out[k] = out.get(k, 0) + 1
    return out


WIKI = """{{Infobox x
| a = [[b]]
* no item
}}
Some '''text''' with $5 and later $7. Here 2 == 2.

== One ==
* a
** b
#x ''c''
#* d
=== ''Two'' ===  
<nowiki>== no ==</nowiki>
<!-- == no ==
* no -->
<pre>
== no ==
</pre>
{| class="t"
| * || 3
|}
The <math>a</math> and {{math|b}} and $x_1$ hold.
:<math display="block">c</math>
```
# code
```
<ol><li>e</li><LI class='e'>f</ol>
Title
----
"""


def test_wiki():
    assert count(WIKI) == {"heading": 2, "list_item": 6, "code": 2, "formula": 4}


MARKDOWN = """# One
Two
===
*Three* is **bold** and [x](y), `# no`, paid \\$5 and \\$6.

Four
----

- a
  * b
1) c
+ d

> quote

~~~py
# no
- no
~~~
$$x$$ and \\(y\\) and $z$.
<h3>
 Five
</h3>
***
"""


def test_markdown():
    assert count(MARKDOWN) == {"heading": 4, "list_item": 4, "code": 1, "formula": 3}


LATEX = r"""\section*{One} \label{a}
Text \emph{b} for 5\$ or 10\%.
% \section{no}
\subsection{Two}
\begin{itemize}
  \item a
  \item[x] b
\end{itemize}
\begin{lstlisting}
\item no $x$
\end{lstlisting}
\begin{align*}
 a &= b \\ c &= d
\end{align*}
\[ e \] and $f$.
"""


def test_latex():
    assert count(LATEX) == {"heading": 2, "list_item": 2, "code": 1, "formula": 3}


HTML = """<p>Text < 30 m and > 3 m.<br/></p><h2 id='x'><span>One</span></h2><H4>Two</H4>
<ul><li>a<li>b<ul><li>c</li></ul></li></ul>
<script>var h = '<h2>no</h2>';</script><style>li {}</style><!-- <h2>no</h2><li>no -->
<PRE class="c"># no
* no</PRE><pre><code>x</code></pre> <code>y</code>
"""


def test_html():
    assert count(HTML) == {"heading": 2, "list_item": 3, "code": 2}


def test_odd_pages(spark):
    assert count(None) == count("") == count(" \n") == count("#REDIRECT [[A]]") == {}
    assert count("Plain text. The C# port is ranked #1 of 3 for $5.") == {}
    assert count("* a\r\n* b\r\n") == {"list_item": 2}
    for broken in ("<!-- == a ==", "```\n# a", "{{x|{{y", "<pre>", "$$a", "\\begin{align} a", "[[" * 50, "{|", "<math>x", "`a", "1"):
        count(broken)
    long = "== H ==\n* i\n\ntext here.\n\n" * 4_000
    assert count(long) == {"heading": 4_000, "list_item": 4_000}
    df = spark.createDataFrame([(1, WIKI, "k"), (1, WIKI, "k"), (2, None, "k"), (3, "x", "k")], "page_id long, t string, key string")
    assert M.page_elements(df, "page_id", "t", WEIGHTS).count() == 14
    assert rows(M.page_elements(df.where("false"), "page_id", "t")) == []
    got = {r.key: r.text for r in M.clean_pages(df, "page_id", "t", WEIGHTS).collect()}
    assert got[2] is None and got[3] == "x" and "# One" in got[1] and "- a" in got[1] and "Infobox" not in got[1] and "'''" not in got[1]


BOILERPLATE = """<nav><h3>Menu</h3><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
{{Infobox mill
| name = Old mill
| parts =
* wheel
* [[stone]]
}}

== Lake ==
The lake of Brudoge covers many fields and hills since the great flood.

* The first mill stood here until the old bridge fell.
* Second mill
<script>x = '<h2>no</h2><li>no</li>';</script>
{{Navbox
== More lakes ==
* [[Lake one]]
* [[Lake two]]
}}
<footer><ul><li>© 2020 Lakes</li><li><a href="/c">Contact</a></li></ul></footer>
"""


def test_the_cut_decides():
    """Headings and items in navigation, infoboxes, scripts and footers are read, and only the cut leaves them out."""
    off = M.elements(M.blocks(BOILERPLATE))
    assert sum(k == "heading" for k, _ in off) == 4 and sum(k == "list_item" for k, _ in off) == 11
    assert count(BOILERPLATE) == {"heading": 1, "list_item": 2}
    text = M.render(M.parse(BOILERPLATE, WEIGHTS))
    assert text.split("\n")[0] == "# Lake" and "Brudoge" in text and not any(x in text for x in ("Menu", "Home", "wheel", "no", "Lake one", "Contact"))


def test_held_out_pages():
    """Pages with content and boilerplate in known places, from a seed that training hasn't seen."""
    right, n, off = 0, 0, 0
    for bs, labels in M.planted(CORPUS, 150, seed=99):
        M.label(bs, WEIGHTS)
        for b, k in zip(bs, labels):
            if k is not None:
                n += 1
                right += b.keep == bool(k)
                off += k
    assert n > 1_500 and right / n > 0.98 and off / n < 0.8


def test_labels_are_the_cheapest():
    """Deciding the sure blocks first gives the same cost as the cut over all of them."""
    rnd = random.Random(11)
    for seed in range(40):
        w = WEIGHTS * rnd.choice((0.05, 0.2, 1.0))  # small weights leave more to the edges
        bs = M.planted(CORPUS, 1, seed=seed)[0][0][:14]
        if len(bs) < 3:
            continue
        z = M.features(bs) @ w
        content, boiler = [float(x) for x in M.np.logaddexp(0, z)], [float(x) for x in M.np.logaddexp(0, -z)]
        edges, last = [], {}
        for i, b in enumerate(bs):
            if i:
                edges.append((i - 1, i, M.NEXT if b.box == bs[i - 1].box else M.ACROSS))
            if b.box:
                if last.get(b.box, i) < i - 1:
                    edges.append((last[b.box], i, M.SAME))
                last[b.box] = i
        M.label(bs, w)
        cost = sum(o if b.keep else c for b, c, o in zip(bs, content, boiler)) + sum(c for u, v, c in edges if bs[u].keep != bs[v].keep)
        assert abs(cost - brute_cut(content, boiler, edges)) < 1e-6


def brute_cut(content, boiler, edges):
    best = None
    for bits in range(1 << len(content)):
        keep = [bool(bits >> i & 1) for i in range(len(content))]
        cost = sum(b if k else c for k, c, b in zip(keep, content, boiler)) + sum(w for u, v, w in edges if keep[u] != keep[v])
        best = cost if best is None else min(best, cost)
    return best


def test_min_cut():
    rnd = random.Random(5)
    for _ in range(150):
        n = rnd.randrange(1, 9)
        content, boiler = [rnd.random() * 3 for _ in range(n)], [rnd.random() * 3 for _ in range(n)]
        edges = [(u, v, rnd.random()) for u in range(n) for v in range(u) if rnd.random() < 0.5]
        keep = M.min_cut(content, boiler, edges)
        cost = sum(b if k else c for k, c, b in zip(keep, content, boiler)) + sum(w for u, v, w in edges if keep[u] != keep[v])
        assert abs(cost - brute_cut(content, boiler, edges)) < 1e-9


# --- tokens ---

needs_tokenizer = pytest.mark.skipif(not __import__("os").path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


@needs_tokenizer
def test_tokens_equal_the_tokenizer(spark):
    enc = tokens.encoder()
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeet \n'sé日本Ж1") for _ in range(rnd.randrange(1, 400))) for _ in range(120)] + ["a" * 5000, "日本" * 3000, "x \n\n  " + "word" * 90 + " \n\n" + "7" * 200 + "\t \n" + "-" * 300 + "  end", "ab" * 4000 + " c", " " * 3000, "don't  \n\n x"]
    for t in texts:
        assert tokens.encode_text(t, enc, 16) == enc.encode_ordinary(t)
        for size in (3, 20, 150):  # pieces beyond it are chunks, joined as a tree
            parts = tokens.split_text(t, size)
            assert "".join(p for _, p in parts) == t
            assert tokens.join_parts([(k, enc.encode_ordinary(p) if k == tokens.TEXT else tokens.encode_piece(p.encode(), enc, 16)) for k, p in parts], enc) == enc.encode_ordinary(t)
        assert enc.decode(tokens.encode_text(t, enc, 16)) == t
    assert tokens.encode_text("<|endoftext|>", enc) == enc.encode_ordinary("<|endoftext|>")


@needs_tokenizer
def test_token_rows(spark):
    big = "the lake, 日本 x's\n" * 20_000
    df = spark.createDataFrame([(1, "a b", 1), (2, "", 1), (3, None, 1), (4, big, 1), (4, big, 1), (None, "x", 1), (5, "y" * 30_000, 1), (6, "the end.\n\n" + "日本語" * 9_000 + "  x", 1)], "doc_id long, text string, key int")
    got = tokens.encode_corpus(df, "doc_id", "text", long_text=1_000, part=700).collect()
    enc = tokens.encoder()
    assert len(got) == 8
    by = {}
    for r in got:
        by.setdefault(r.key, []).append(r.ids)
    assert by[2] == by[3] == [[]] and by[4] == [enc.encode_ordinary(big)] * 2 and by[None] == [enc.encode_ordinary("x")] and by[5] == [enc.encode_ordinary("y" * 30_000)]
    assert by[6] == [enc.encode_ordinary("the end.\n\n" + "日本語" * 9_000 + "  x")]
    assert tokens.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


# --- leakage ---


def brute_leak(doc, passage, n=8):
    d, p = leakage.words(doc), leakage.words(passage)
    covered = set()
    for i in range(len(p) - n + 1):
        if any(d[j : j + n] == p[i : i + n] for j in range(len(d) - n + 1)):
            covered |= set(range(i, i + n))
    return len(covered)


def test_leaks(spark):
    rnd = random.Random(4)
    vocab = [f"wórd{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 40))) + ".") for i in range(12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(3):
            w = rnd.choice(items)[1].split()
            a = rnd.randrange(len(w))
            parts += w[a : a + rnd.randrange(1, 25)] + [rnd.choice(vocab)]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1].upper().replace("Ó", "O").replace(" ", ",  "))]
    items += [(98, None), (99, "")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item int")
    e = spark.createDataFrame([(*x, 1) for x in items], "item_id long, passage string, doc int")
    got = {(r.doc, r.item): r.n_covered for r in leakage.leaks(d, "doc_id", "text", e, "item_id", "passage").collect()}
    want = {(a, b): n for a, t in docs if t for b, p in items if p and (n := brute_leak(t, p))}
    assert got == want
    assert rows(leakage.leaked(leakage.leaks(d.where("false"), "doc_id", "text", e, "item_id", "passage"))) == []
    assert rows(leakage.leaked(leakage.leaks(d, "doc_id", "text", e.where("false"), "item_id", "passage"))) == []


def test_offsets(spark):
    p = "one two three four five six seven eight nine ten"
    text = "Intro. <b>One</b>, two-[[x|three]] FÖUR fïve **six** seven eight"
    d = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    e = spark.createDataFrame([(7, p), (8, "a b c d e f g h i")], "item_id long, passage string")
    r = leakage.leaks(d, "doc_id", "text", e, "item_id", "passage", block_chars=10).collect()  # an automaton for each item
    assert len(r) == 2 and (r[0].item, r[0].n_words, r[0].n_covered) == (7, 10, 8)
    assert text[r[0].starts[0] : r[0].ends[0]].startswith("One") and text[r[0].starts[0] : r[0].ends[0]].endswith("eight")


def test_seeds_are_small():
    """The automaton of much test text stays within its bound: 40 bytes a character."""
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 11))) for _ in range(30_000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(300))) for i in range(200)]
    seeds = leakage.Seeds(items)
    assert seeds.automaton.get_stats()["total_size"] < 40 * sum(len(t) for _, t in items)
    hit = seeds.scan("Intro " + items[7][1].upper() + ", " + " ".join(items[9][1].split()[100:108]))
    assert {k: (v[0], v[1]) for k, v in hit.items()} == {7: (300, 300), 9: (300, 8)}


# --- wrong encodings ---


def sentences(rnd, n):
    en = "the lake of Brüdogé covers {} hectares near Köziná — “Lávode” says less since {}."
    fr = "La commune de Zuféla comptait {} habitants à Pâlonê, selon « Drîbu » après {}."
    ru = "После {} года Ребежова потеряла часть Дезожазо — гавань около Тонипело, {} году."
    ja = "{}年、ビリノギの石切場はヴェグラに売却された。項目には{}件の文がある。"
    return [rnd.choice((en, en, fr, ru, ja)).format(rnd.randrange(2000), rnd.randrange(2000)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return mojibake.Classifier.train(sentences(random.Random(7), 400))


def test_round_trip():
    for chain in mojibake.CHAINS:
        t = "日本項目" if "jp" in chain or "sjis" in chain else "Привет" if chain.startswith(("koi8", "cp1251")) else "Ναι" if chain.startswith("cp1253") else "Brüdogé"
        g = mojibake.garble(t, chain)
        assert g != t and mojibake.restore(g, chain) == t


def test_held_out(model):
    """Held-out records: clean ones stay, garbled ones are found and restored."""
    rnd = random.Random(8)
    clean = sentences(rnd, 200)
    assert sum(model.repair(t) is not None for t in clean) == 0
    tried = right = 0
    for t in clean:
        for chain in ("utf8-cp1252", "utf8-latin1", "utf8-cp1252-twice", "utf8-cp437", "utf8-mac", "cp1252-cp437", "cp1252-mac", "koi8-cp1251", "cp1251-cp1252", "eucjp-cp1252"):
            part = " ".join(t.split()[2:])
            g = mojibake.garble(part, chain)
            if g == part or mojibake.restore(g, chain) != part or sum(not c.isascii() for c in part) < 3:
                continue
            hit = model.repair("Clean words. " + g)
            tried += 1
            right += hit is not None and hit[3] == "Clean words. " + part
    assert tried > 300 and right / tried > 0.95


def test_capitals_are_not_lost_bytes(model):
    """Clean words that are rare in the sample aren't taken for what a lossy chain leaves: nothing is replaced in them."""
    for t in ("NÖRDLICHE ANLAGE BEI TUPASTODRU, ERWÄHNT IM JAHR 1361.", "ÉLÉMENT ÎLE", "ΝΗΣΟΣ ΒΙΒΛΙΟ", "ÄÖÜ ẞ"):
        hit = model.repair(t)
        assert hit is None or "lost" not in hit[0]


def test_several_chains(model):
    """Stretches of different chains, twice garbled ones and lost bytes in one text: all that can be is put right."""
    a, b, c = "Brüdogé covers Köziná", "La commune de Zuféla à Pâlonê", "гавань около Тонипело"
    t = f"{mojibake.garble(a, 'utf8-cp1252')} and {mojibake.garble(b, 'utf8-mac')}; {mojibake.garble(c, 'utf8-cp1252-twice')}."
    chains, start, stop, restored, complete = model.repair(t)
    assert restored == f"{a} and {b}; {c}." and complete and len(chains.split("+")) > 1
    lost = mojibake.garble("Zuféla à Pâlonê Drîbu", "cp1252-utf8-lost")
    chains, start, stop, restored, complete = model.repair(f"{lost} and {mojibake.garble(a, 'utf8-cp1252')}")
    assert restored == f"{lost} and {a}" and not complete and "lost" in chains


def test_restored_records(model):
    """Share of held-out records, garbled whole, that come back exactly; and what the test of regular text is for."""
    rnd = random.Random(21)
    tried = right = 0
    for t in sentences(rnd, 150):
        for chain in mojibake.CHAINS:
            g = mojibake.garble(t, chain)
            if g != t and mojibake.restore(g, chain) == t and sum(not c.isascii() for c in t) > 3:
                hit = model.repair(g)
                tried += 1
                right += hit is not None and hit[3] == t and hit[4]
    assert tried > 500 and right / tried > 0.9


def test_garbled_rows(spark, model):
    bad = mojibake.garble("Brüdogé covers Köziná", "utf8-cp1252")
    data = [(1, "plain"), (2, None), (3, ""), (4, bad), (4, bad), (5, "lost � byte"), (6, "x " * 100_000 + bad), (7, "Ã and Â stand alone, £4, ½")]
    df = spark.createDataFrame([(*d, "c") for d in data], "doc_id long, text string, chain string")
    got = mojibake.garbled(df, "doc_id", "text", model).collect()
    assert sorted(r.doc for r in got) == [4, 4, 5, 6]
    assert {r.restored for r in got if r.doc == 4} == {"Brüdogé covers Köziná"} and [r.restored for r in got if r.doc == 5] == [None]
    assert mojibake.garbled(df.where("false"), "doc_id", "text").count() == 0
