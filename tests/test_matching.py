"""Patterns in all engines: what is found, in which time, and what bad bytes are."""

import random
import time

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from linescan.functions.dialect import java_form, one_pass, plan, tokens
from linescan.functions.matching import check_pattern, find_in_batch, java_pattern, matches
from linescan.plans.search import match_lines

#: By the engine that each is for.
PATTERNS = {
    "jvm": [
        "ab", "a.b", "ab|ba|1$", "^a", "a{2,3}b?c", "(ab|ba).*1", "a.*b.*1", "ab.*?c.+b", r"[ab]\d", "(?i)AB", r"\bab\b", "a+", "x*", ".*b", "^.*1", r"^\w+1", r"[^a]b", r"a\Wb", "é.*b",
        r"\Q[a\E", r"\x61b|é", "(a|b|1)(b|c)", "ab.*|ba", r"^a.*b.*c$", "(?<n>a)b", "a b", r"\Aab", r"ab\z",
    ],
    "re2": ["(?:a|b)*c", "(ab)+1", r"a\d*b", "[^a].*b", r"(\w+ )*ab", "ba+b+c", r"1\w+\s\w+", r"(a.)*\bb", r"(\d|a)+b\b", "(?i:A)b", "(?s)a.b", r"a\p{Lu}+b", r"(?m)^b", r"a[\wé]+1$", r"a\S+1", r"1[\s1]+b"],
    "other": [r"(ab|ba).*\1", r"(?<=a)b", "a(?!b)", r"(?:(a)|b)*\1c", "(?>a+)b", r"(?<w>a|b)\k<w>", "a++b"],
}


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice(["ab", "a", "b", "AB", "c", "1", "é", " ", "\r", "ſ", "日", "[", "Ⓐ", "ba"]) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    return spark.createDataFrame([(t,) for t in texts], "value string").repartition(2).cache()


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("kind", list(PATTERNS))
def test_all_engines_find_the_same(spark, lines, kind, fold):
    """On valid text a pattern finds what Spark's own matcher finds with it."""
    for pattern in PATTERNS[kind]:
        how = plan(pattern, fold)
        assert kind == "other" or how.engine == kind, (pattern, how)
        check_pattern(spark, pattern, fold)
        rows = lines.select("value", matches(F.col("value"), pattern, fold).alias("a"), F.col("value").rlike(java_pattern(pattern, fold)).alias("b")).collect()
        assert [r.value for r in rows if r.a != r.b] == [], pattern
        assert any(r.a for r in rows), pattern


def test_values_of_several_lines(spark):
    """One-pass forms take a line of the value at a time; other pieces go to the automaton."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", "b", "1", "\n", "c", "a\n"]) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    for pattern in ("(ab|ba).*1", "a.*b.*1", "^ab.*1", "[^a].*b", "b[^c].*1", r"a\n.*b", r"a\s.*b", "ab.*[^1]c", r"a.*b\b"):
        rows = frame.select("value", matches(F.col("value"), pattern).alias("a"), F.col("value").rlike(java_pattern(pattern)).alias("b")).collect()
        assert [r.value for r in rows if r.a != r.b] == [], pattern


def test_bad_bytes_are_no_characters(spark):
    values = [b"a\xffb", "a�b".encode(), b"axb", b"a\xffb \xef\xbf\xbd axb", b"\xff\xfe", b"", b"ab\xff", b"\xc3", "�".encode(), b"a\xe2\x82b", b"\xffab", b"x\xff1", b"ab \xff 1"]
    frame = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, raw binary").select("i", F.col("raw").cast("string").alias("value"))
    for pattern in ("a.b", "a[^x]b", r"a\Wb", "ab$", "^ab", ".", "[^q]", "", "(ab|xx).*1", r"\S", "(?:.|q)+b", r"(?:a.)*b", "a[^q]*b", r"�", "�", r"(?:\bab)+", r"(.)\1", r"(?:(.)x)*\1", r"a\P{L}b"):
        got = {r.i for r in match_lines(frame, pattern).collect()}
        # The same over text in which a bad byte is a character that the pattern cannot hold.
        exact = regex.compile(pattern.replace("\\P{L}", "[^\\p{L}]"), regex.V1)
        want = set()
        for i, v in enumerate(values):
            spots = [m for m in exact.finditer(v.decode("utf-8", "surrogateescape"), overlapped=True)]
            spots = [m for m in spots if not any("\udc80" <= c <= "\udcff" for c in m[0])]
            if spots:
                want.add(i)
        assert got == want, (pattern, got, want)
    kept = match_lines(frame, None).select(F.col("value").cast("binary").alias("v")).collect()
    assert [bytes(r.v) for r in kept] == values  # whatever they are, they pass unchanged


def test_no_line_ends_the_session(spark):
    long = spark.range(1).select(F.concat(F.repeat(F.lit("xy"), 500_000), F.lit("w")).alias("value"))
    began = time.monotonic()
    for pattern in ("(?:x|y)*z", "(x|y)+w", r"(?:x+y*)+z", "(xy)*w$", "x.*y.*z", "x.*x.*x.*z", "[xy]+z", r"(\w|y)*\bz", "(?:xy|x)*?w"):
        assert match_lines(long, pattern).count() == (1 if pattern.rstrip("$").endswith("w") else 0), pattern
    assert time.monotonic() - began < 60
    short = spark.range(1).select(F.repeat(F.lit("xy"), 500).alias("value"))
    for pattern in (r"(?:(x)|y)*\1z", r"(?:x|y)*(?=z)"):
        assert match_lines(short, pattern).count() == 0


def test_a_line_that_takes_too_long_is_an_error(monkeypatch):
    monkeypatch.setattr("linescan.functions.matching.LINE_SECONDS", 0.05)
    with pytest.raises(TimeoutError, match="a line takes more than 0.05 s"):
        find_in_batch(pa.array([b"xy" * 10_000], pa.binary()), plan(r"(?:x|y)*(?=z)"))


def test_slices_and_nulls():
    how = plan("(?:a|b)+c")
    values = pa.array([b"abc", None, b"x", b"bbc"], pa.binary())
    assert find_in_batch(values, how).to_pylist() == [True, None, False, True]
    assert find_in_batch(values.slice(1, 3), how).to_pylist() == [None, False, True]
    assert find_in_batch(values.cast(pa.large_binary()).slice(2), how).to_pylist() == [False, True]
    words = plan(r"(?:a|b)*\bc")
    assert find_in_batch(pa.array([b"a c", "éc".encode(), "é c".encode(), None], pa.binary()), words).to_pylist() == [True, False, True, None]
    assert find_in_batch(pa.array([None, b"aa", b"ab"], pa.binary()), plan(r"(?:(a)|c)+\1")).to_pylist() == [None, True, False]


def test_bad_patterns(spark):
    for pattern in ("[invalid", "(", ")", "a)", "*a", "+", "a{3,2}", "a\\", "(?<1>a)", "(?", "[z-a]+b+", r"\p{Nonsense}", "a|*", r"(?:(a)|b)*\k<q>"):
        with pytest.raises(ValueError, match="Invalid regex pattern"):
            check_pattern(spark, pattern)
        with pytest.raises(ValueError, match="Invalid regex pattern"):
            match_lines(spark.createDataFrame([("a",)], "value string"), pattern)


def test_forms():
    form = lambda p: (found := one_pass(tokens(p))) and java_form(found)
    assert form("(the|und).*[0-9]") == "(?m:^)(?>.*?(the|und)).*[0-9]"
    assert form("a.*b.+c") == "(?m:^)(?>.*?a)(?>.*?b.).*c"
    assert form("^ab.*c$") == "^ab.*c$" and form(".*ab+") == "ab" and form("a{2,}") == "a{2,2}"
    assert form("a+b") == "ab"
    for other in ("ba+b", "(the|a).*x", "(ab)*", r"(a)\1", "a(?=b)", "a++b", "^a+b+c", "[^a].*b"):
        assert form(other) is None, other
