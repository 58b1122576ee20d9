import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodetext.functions import bm25
from lodetext.functions.tokenizer import Term, parse_terms, tokenize, tokens
from lodetext.plans import query as Q
from lodetext.plans import pruning as P


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("port 443", ["port", "443"]),
        ("TLS1.3", ["tls1", "3"]),
        ("connection_refused", ["connection", "refused"]),
        ("error error", ["error", "error"]),
        ("é", ["é"]),
        ("ΟΔΟΣ", ["οδοσ"]),
        ("a" * 256, ["a" * 256]),
        ("a" * 257, []),
        ("!!! --", []),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    assert tokenize(text) == expected
    assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0] == expected


def test_null_text_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(tokens(F.col("t"))).first()[0] is None


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aBéÉßΣ1٣_.-' \ń", max_size=12), min_size=1, max_size=20))
def test_column_and_python_agree(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("k")).collect()
    assert all(r.k == tokenize(r.t) for r in rows)


def test_all_scripts_agree(spark):
    """Query text and data are split alike, for words with marks of every script and for normal forms."""
    import unicodedata

    words = ["भाषा", "हिन्दी", "Ⓐ", "தமிழ்", "ไทย", "עִבְרִית", "العربيّة", "e\u0301te\u0301", "İstanbul", "ΟΔΟΣ", "½", "Ⅷ", "a\u2014b", "한글", "각", "\u212bngstrom", "x\u0345y"]
    for block in range(0x300, 0x3000, 7):
        if unicodedata.category(chr(block)) != "Cn":
            words.append(f"a{chr(block)}b {chr(block)}")
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", tokens(F.col("t")).alias("k")).collect()
    assert [r.t for r in rows if r.k != tokenize(r.t)] == []
    from lodetext.operators import scan_search as S

    docs = spark.createDataFrame([(w,) for w in words], "t string")
    assert all(S.search(docs, Q.Match("t", w)).count() >= 1 for w in ("भाषा", "हिन्दी", "Ⓐ", "été"))


def test_texts_are_split_once(spark):
    from lodetext.operators import scan_search as S

    docs = spark.createDataFrame([("a b",)], "t string")
    hits = S.search(docs, Q.Match("t", "a b c d e f"), scored=True)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(_lt_low0") == 1 and hits.columns == ["t", "score"]


def test_wildcards():
    assert parse_terms("Foo* *bar baz qux_1") == [Term("foo", "prefix"), Term("bar", "suffix"), Term("baz"), Term("qux"), Term("1")]
    for bad in ("*", "a*b", "*a*", "a_b*", "**a", "-*"):
        with pytest.raises(ValueError):
            parse_terms(bad)


@pytest.mark.parametrize(
    ("tf", "dl", "avg", "df", "n", "expected"),
    [
        (1, 100, 100, 10, 10_000, 6.859065109813038),
        (3, 100, 100, 10, 10_000, 10.77853088684906),
        (1, 50, 100, 10, 10_000, 8.622824709479248),
        (1, 200, 100, 10, 10_000, 4.867723626318931),
        (1, 100, 100, 5_000, 10_000, 0.6931471805599453),
        (5, 50, 200, 100, 1_000_000, 18.32740129142282),
    ],
)
def test_bm25_golden(tf, dl, avg, df, n, expected):
    assert bm25.score(tf, dl, avg, df, n) == pytest.approx(expected, abs=1e-6)


def test_json_grammar():
    tree = Q.from_json({"and": [{"column": "a", "match": "x"}, {"or": [{"column": "b", "match": "y", "operator": "and"}]}]})
    assert tree == Q.And((Q.Match("a", "x"), Q.Or((Q.Match("b", "y", "and"),))))
    assert Q.multi_column(["a", "b"], "x") == Q.Or((Q.Match("a", "x"), Q.Match("b", "x")))
    for bad in ({"and": []}, {"not": {}}, {"column": "a"}, {"column": "a", "match": "x", "operator": "xor"}, {"or": [{}], "and": [{}]}, {"column": "a", "match": "x", "extra": 1}):
        with pytest.raises(ValueError):
            Q.from_json(bad)


def test_segment_ranges():
    s = {"min_term": "bravo", "max_term": "mike", "term_count": 5}
    assert P.overlaps(s, Term("bravo")) and P.overlaps(s, Term("mike")) and not P.overlaps(s, Term("alpha")) and not P.overlaps(s, Term("zulu"))
    assert P.overlaps(s, Term("br", "prefix")) and not P.overlaps(s, Term("n", "prefix")) and P.overlaps(s, Term("zulu", "suffix"))
    assert P.prune_segments([s], Q.Match("c", "alpha delta", "and")) == [] and P.prune_segments([s], Q.Match("c", "alpha delta")) == [s]


def test_sql_functions(spark):
    from lodetext.functions.sql import register

    register(spark)
    row = spark.sql("SELECT lt_tokenize('Port 443') AS t, lt_match_any('a b', 'b c') AS x, lt_match_all('a b', 'b c') AS y, lt_match_any(NULL, 'a') AS z, lt_bm25(3, 100, 100, 10, 10000) AS s").first()
    assert (row.t, row.x, row.y, row.z) == (["port", "443"], True, False, False) and row.s == pytest.approx(10.77853088684906)
