from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from pyspark.sql import functions as F

from factlake.functions import ids, numbers, similarity as S, text

WORDS = st.text("abcd ", max_size=9)


def slow_levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_similarities(a, b):
    assert S.common_subsequence(a, b) == slow_lcs(a, b)
    assert S.damerau(a, b) == S.damerau(b, a) <= slow_levenshtein(a, b)
    assert S.hamming(a, b) == S.hamming(b, a)
    for f in (S.jaro, S.jaro_winkler, S.ratio, S.partial_ratio, S.token_sort_ratio, S.token_set_ratio, S.weighted_ratio, S.blend):
        assert 0 <= f(a, b) <= 1
        if a.strip():
            assert f(a, a) == 1


def test_known_values():
    assert S.damerau("ca", "abc") == 2
    assert round(S.jaro("martha", "marhta"), 4) == 0.9444 and round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert S.token_set_ratio("old mill", "mill") == 1 and S.token_sort_ratio("a b", "b a") == 1 and S.partial_ratio("mill", "the mill road") == 1
    assert text.delete_edits("abc", 1, 10) == {"abc", "ab", "ac", "bc"} and text.delete_edits("", 2, 5) == set() and len(text.delete_edits("abcdefghijklmn", 2, 14)) == 106


def test_udfs_and_nulls(spark):
    df = spark.createDataFrame([("abc", "acb"), ("", "x"), (None, "x"), ("a", None)], "a string, b string")
    assert rows(df.select(S.dis_damerau("a", "b"), S.dis_hamming("a", "b"), S.dis_levenshtein(F.col("a"), F.col("b")))) == [(0, 0, 0), (1, 2, 2), (None, None, None), (None, None, None)]
    assert [r[0] for r in df.select(S.sim_ratio("a", "b")).collect()] == [S.ratio("abc", "acb"), 0.0, None, None]
    assert df.where("false").select(S.sim_blend("a", "b")).count() == 0


def test_text(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(ids.plain_id, " http://KB.example/entity/q12 ") == "Q12" and one(ids.plain_id, None) is None
    assert one(ids.plain_title, "mount_X  ") == "Mount X" and one(ids.plain_title, "") == "" and one(ids.plain_title, None) is None
    assert one(text.norm_text, "Café​  ooooh ＡＢ") == "café ooh ab" and one(lambda c: text.norm_text(c, True), "?!") == "?!" and one(lambda c: text.norm_text(c, article=True), "The Old and Mill") == "old mill"
    for t, want in {"[[A|b]] (x": "[[A|b]] x", "See [[A]]": "", "a [[B#c]] d": "a  d", "x [[B#c": "x", "y]] z": "z", "(a) b)": "(a) b)", "a) b": "a b", "see": "", "[[a]]": "[[a]]", "#[[a]": "#"}.items():
        assert one(text.clean_brackets, t) == want, t
    assert one(text.norm_query, "Re: The  Mill and a Lake") == " mill lake" and one(text.norm_query, "re:x") == "x"
    assert one(lambda c: text.remove_spans(c, [("<ref", "/ref>"), ("(", ")")]), "a<ref>b/ref> (c) (d") == "a  (d" and one(lambda c: text.remove_parts(c, ["<b>", "&"]), "a<b>c&") == "a c"
    assert one(text.abbreviate, "Ada " + "x " * 3000) == "A. " + ("x " * 3000).strip()
    assert one(text.strip_tags, "a<br/>b  c") == "a b c"
    assert one(text.abbreviate, "Ada Love King") == "A. Love King" and one(text.abbreviate, "Ada") is None
    assert one(text.strip_namespaces, "<http://kb.example/resource/X>") == "X"
    assert one(numbers.convert_num, "1,234.5") == 1234.5 and one(numbers.convert_num, "x") is None
    assert one(numbers.get_date, "3 March 1951") == "1951-03-03" and one(numbers.get_date, "March 1951") == "1951-03-01" and one(numbers.get_date, "1951") is None
    assert one(lambda c: numbers.size_text(c.cast("double")), "1536") == "1.5 KB"
    assert one(lambda c: numbers.binomial(c.cast("int"), F.lit(2)), "1") == 0 and one(lambda c: numbers.binomial(c.cast("int"), F.lit(3)), "50") == 19600
    assert one(lambda c: S.sim_change(c, F.lit("0")), "0") == 1.0 and one(lambda c: S.sim_change(c, F.lit("0")), "x") == 0.0
