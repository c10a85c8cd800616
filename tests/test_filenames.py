from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import filenames as fn
from quire.operators import greedy


@given(st.text("ab $\\{}x1-.:", max_size=30))
@settings(max_examples=200, deadline=None)
def test_segments_cover(text):
    parts = fn._segments(text)
    assert "".join(text[a:b] for _, a, b in parts) == text
    assert all(x[2] == y[1] for x, y in zip(parts, parts[1:], strict=False))


def test_sentence_case():
    f = fn.sentence_case_of
    assert f("On The DNA of McLane Rings: The End") == "On the DNA of McLane rings: The end"
    assert f("ON RINGS AND $X^2$ FLOWS") == "On rings and $X^2$ flows"
    assert f("The Banach Space", frozenset({"banach"})) == "The Banach space" and f("") == "" and f(None) is None
    for t in ("A Title: Of Things", "x", "ÉCOLE NORMALE"):
        assert f(f(t)) == f(t)


def test_names(spark):
    d = spark.createDataFrame([(["A, B.", "C, D.", "É, F."], "Some: Title"), ([], "T")], "a array<string>, t string")
    got = [r[0] for r in d.select(fn.canonical_name(F.col("a"), "t", 33)).collect()]
    assert got == ["A, B., C, D. et al. - Some, Title", " - T"]
    assert d.select(fn.initials(F.lit("Anne-Lise Maria")), fn.accents(F.lit(r"\'{e}\"u")), fn.spaced_name(F.lit("A ,B  -  x--y"))).first()[:] == ("A.-L. M.", "éü", "A, B - x–y")


def test_intervals(spark):
    d = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 5, 6), ("a", 8, 9), ("b", 1, 1)], "k string, x int, y int")
    assert {tuple(r) for r in fn.merged_intervals(d, "k", "x", "y").collect()} == {("a", 1, 6), ("a", 8, 9), ("b", 1, 1)}


def test_order_decides(spark):
    d = spark.createDataFrame([(1, "the same long title here is one"), (2, "the same long title here is ono"), (3, "the same long title here of another work"), (4, None), (5, " "), (6, "the same long title here is one")], "id long, t string")
    assert sorted(r["id"] for r in greedy.first_wins(d, "id", "t").collect()) == [1, 3]
    w = spark.createDataFrame([(1, 5.0, 10.0, "b", 9.0), (1, 1.0, 11.0, "a", 9.0), (1, 1.0, 14.0, "longer", 7.0)], "page int, x double, y double, text string, size double")
    assert [(r["line"], r["text"], r["size"]) for r in greedy.lines_of_words(w, "page").orderBy("line").collect()] == [(0, "a b", 9.0), (1, "longer", 7.0)]
    e = spark.createDataFrame([("x", 1, "no"), ("x", 2, "ok"), ("y", 1, "no"), ("z", 1, "no"), ("z", 2, "no"), ("z", 3, "no")], "k string, t int, o string")
    assert {tuple(r) for r in greedy.replay(e, "k", "t", "o").collect()} == {("x", 2, "done", None), ("y", 1, "waiting", 2), ("z", 3, "failed", None)}
