"""Splitting, cleaning and display, on literal expectations."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import clean, split
from corpusloom.functions.rules import RULESETS, pattern_of

CL, O2 = "cl100k_base", "o200k_base"
CASES = [
    (CL, "a\n\nb", ["a", "\n\n", "b"]),
    (CL, "a\nb", ["a", "\n", "b"]),
    (CL, "\n", ["\n"]),
    (CL, "\n\n", ["\n\n"]),
    (CL, "IT'S", ["IT", "'S"]),
    (CL, "2024/01/15", ["202", "4", "/", "01", "/", "15"]),
    (CL, "hello world", ["hello", " world"]),
    (CL, "   hello  world", ["  ", " hello", " ", " world"]),
    (CL, "hello world", ["hello", " world"]),
    (CL, "  a", [" ", " a"]),
    (CL, "a  ", ["a", "  "]),
    (CL, "   ", ["   "]),
    (CL, " a", [" a"]),
    (CL, "a ", ["a", " "]),
    (CL, "hello世界", ["hello世界"]),
    (CL, "世界", ["世界"]),
    (CL, "hi😀there", ["hi", "😀there"]),
    (CL, "   \n  ", ["   \n  "]),
    (CL, "", []),
    (CL, "x'ſy", ["x", "'ſ", "y"]),
    (CL, "they're 2024", ["they", "'re", " ", "202", "4"]),
    (O2, "IT'S", ["IT'S"]),
    (O2, "hello world", ["hello", " world"]),
    (O2, "a\n\nb", ["a", "\n\n", "b"]),
    (O2, "2024/01/15", ["202", "4", "/", "01", "/", "15"]),
    (O2, "日A", ["日", "A"]),
    (O2, "́!", ["́", "!"]),
    (O2, "   \n  ", ["   \n", "  "]),
    (O2, "they're 2024", ["they're", " ", "202", "4"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, r, t) for k, (r, t, _) in enumerate(CASES)], "k int, r string, t string")
    got = df.select("k", F.when(F.col("r") == CL, split.chunks(F.col("t"), CL)).otherwise(split.chunks(F.col("t"), O2)).alias("c")).collect()
    assert {r.k: r.c for r in got} == {k: c for k, (_, _, c) in enumerate(CASES)}


def test_unknown_ruleset():
    with pytest.raises(ValueError):
        pattern_of("nope")


def test_null_text(spark):
    assert spark.sql("SELECT CAST(NULL AS string) t").select(split.chunks(F.col("t"))).first()[0] is None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aZ é日1  \n\r\t'.!/😀́ǅ"), max_size=12), min_size=1, max_size=40))
def test_chunks_join_to_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.filter((F.array_join(split.chunks(F.col("t"), CL), "") != F.col("t")) | (F.array_join(split.chunks(F.col("t"), O2), "") != F.col("t")))
    assert bad.count() == 0


def test_custom_pattern_keeps_gaps_and_tail(spark):
    df = spark.createDataFrame([("ab12cd3ef",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(split.chunks_by(F.col("t"), r"\d+")).collect()] == [["ab", "12", "cd", "3", "ef"], [], None]
    assert df.select(split.chunks_by(F.col("t"), r"\d*")).first()[0] == ["a", "b", "12", "c", "d", "3", "e", "f"]


R = "�"
BYTES = [
    (b"hello\xffworld", f"hello{R}world"), (b"\x80", R), (b"a\xe2\x82", f"a{R}{R}"), (b"a\xc0\xaf", f"a{R}{R}"), (b"\xed\xa0\x80", R * 3),
    (b"\xf0\x9f\x98", R * 3), (b"", ""), ("hé日😀".encode(), "hé日😀"), (b"\xf5\x80", R * 2), (b"\xe0\x80\x80x", R * 3 + "x"),
]


def test_sanitize(spark):
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(BYTES)], "k int, b binary")
    got = {r.k: r.t for r in df.select("k", clean.sanitize_utf8(F.col("b")).alias("t")).collect()}
    assert got == {k: t for k, (_, t) in enumerate(BYTES)}


def test_sanitize_long_input(spark):
    data = (b"ab\xff\xc3\xa9" * 200_000)
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert df.select(clean.sanitize_utf8(F.col("b"))).first()[0] == f"ab{R}é" * 200_000


def test_normalize(spark):
    one = lambda t, mode: spark.createDataFrame([(t,)], "t string").select(clean.normalize(F.col("t"), mode)).first()[0]
    assert one("ﬁ", "Identity") == "ﬁ" and one("ﬁ", "NFKC") == "fi" and one("ﬁ", "NFKD") == "fi"
    assert one("é", "NFC") == "é" and one("é", "NFD") == "é"
    assert one(None, "NFC") is None
    with pytest.raises(ValueError):
        clean.normalize(F.col("t"), "NFX")


def test_pipeline_on_invalid_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"hello\xffworld"),)], "b binary")
    assert df.select(split.pipeline(F.col("b"))).first()[0] == ["hello", f"{R}world"]


def test_display(spark):
    df = spark.createDataFrame([('a"\\\n\té',), ("",)], "t string")
    shown = df.select(clean.display_escape(F.col("t")), clean.hex_bytes(F.col("t"))).collect()
    assert tuple(shown[0]) == ('a\\"\\\\\\n\\t\\xC3\\xA9', "61 22 5C 0A 09 C3 A9") and tuple(shown[1]) == ("", "(empty)")


def test_rulesets_are_two():
    assert set(RULESETS) == {CL, O2}
