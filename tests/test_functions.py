import unicodedata

import pytest
from pyspark.sql import functions as F

from semforge.functions import ids, text

EDGE = [None, "", " ", "　", " ", "（Ａ）", "Ⅲ①", "10KV", "a？b", "tail-", "-5m", "x" * 501, "AB-01", "设备", "  two  words\t", "ﬁne"]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(EDGE)], "i int, x string")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_nfkc_and_collapse(edge):
    assert column(edge, text.nfkc(F.col("x"))) == [None if x is None else unicodedata.normalize("NFKC", x) for x in EDGE]
    assert column(edge, text.collapse(F.col("x"))) == [None if x is None else " ".join(x.split()) for x in EDGE]


def test_candidate_form(edge):
    want = [" ".join(unicodedata.normalize("NFKC", x or "").split()).strip(" ,，;；:：、·.。-—") for x in EDGE]
    assert column(edge, text.normalize(F.col("x"), "candidate")) == want


def test_identity_form(edge):
    want = [None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c in "0123456789abcdefghijklmnopqrstuvwxyz" or "一" <= c <= "鿿") for x in EDGE]
    assert column(edge, text.normalize(F.col("x"), "identity")) == want


def test_unknown_mode():
    with pytest.raises(ValueError):
        text.normalize(F.lit("x"), "other")


def test_ngrams_jaccard(spark):
    df = spark.createDataFrame([(0, "", "abc"), (1, "a", "a"), (2, "abcd", "bcde"), (3, "aaaa", "aa")], "i int, a string, b string")
    assert column(df, text.jaccard(text.ngrams(F.col("a")), text.ngrams(F.col("b")))) == [0.0, 1.0, 0.5, 1.0]


def test_tokens_and_shapes(spark):
    df = spark.createDataFrame([(0, "12ABC-D7"), (1, ""), (2, None), (3, "ab")], "i int, x string")
    got = column(df, text.alpha_tokens(F.col("x")))
    assert [[tuple(t) for t in g] for g in got] == [[("ABC", 2, 3), ("D", 6, 1)], [], [], []]
    assert column(df, text.code_shape(F.col("x"))) == ["99AAAXA9", "", None, "AA"]


def test_flags(spark):
    df = spark.createDataFrame([(0, "Ⅲ泵 -5℃?"), (1, "plain"), (2, "?x"), (3, "a?b"), (4, "a?b?c")], "i int, x string")
    assert column(df, text.risk_flags(F.col("x"))) == [["roman_numeral", "question_mark", "temperature_unit", "signed_number"], [], ["question_mark"], ["question_mark"], ["question_mark"]]
    assert column(df, text.question_position(F.col("x")))[1:] == ["none", "boundary", "interior_single", "interior_multiple"]


def test_parse(spark):
    df = spark.createDataFrame([(0, "2024-01-01 00:00:00", "1.5"), (1, "2024-01-01T00:00:00Z", "NaN"), (2, "bad", "Infinity"), (3, None, None), (4, "2024-01-01T02:00:00+02:00", "x")], "i int, t string, n string")
    times = column(df, text.parse_time(F.col("t")).cast("string"))
    assert times == ["2024-01-01 00:00:00", "2024-01-01 00:00:00", None, None, "2024-01-01 00:00:00"]
    assert column(df, text.safe_float(F.col("n"), 0.0)) == [1.5, 0.0, 0.0, 0.0, 0.0]


def test_python_backed_functions(spark):
    df = spark.createDataFrame([(0, "Ａb", "Ab"), (1, "ab", "ba"), (2, None, "x")], "i int, a string, b string")
    assert column(df, text.mapping_signature("a", "b")) == ["U+FF21->A", "contextual_or_composed_change", None]
    assert column(df, text.similarity_ratio("a", "b")) == [0.5, 0.5, None]
    assert column(df, text.edit_script("a", "b"))[0] == "replace:Ａ->A"
    assert column(df, text.mapping_group("a")) == ["fullwidth", "", None]
    assert column(df, text.changed_codepoints("a"))[0] == "U+FF21(FULLWIDTH LATIN CAPITAL LETTER A)>A"


def test_ids(spark):
    df = spark.createDataFrame([(0, None, "b~*"), (1, "", "b~*"), (2, "x y+é", None)], "i int, a string, b string")
    got = column(df, ids.stable_id("P", F.col("a"), F.col("b")))
    assert got[0] == got[1] != got[2] and all(len(x) == 26 for x in got)
    assert column(df, ids.iri_segment(F.col("a"))) == ["unknown", "unknown", "x%20y%2B%C3%A9"]
    assert column(df, ids.iri_segment(F.col("b"))) == ["b~%2A", "b~%2A", "unknown"]
    assert column(df, ids.derived_snapshot(F.array("a", "b")))[:2] == ["b~*", "b~*"]
    assert column(df, ids.snake_case(F.lit("HTTPServerName"))) == ["http_server_name"] * 3


def test_content_hash():
    assert ids.content_hash({"b": 1, "a": [{"run_id": 5}]}) == ids.content_hash({"a": [{"run_id": 6}], "b": 1}) != ids.content_hash({"a": [], "b": 1})
