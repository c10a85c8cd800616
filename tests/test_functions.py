import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import similarity as sim
from quire.functions import text as tx
from quire.operators import joins, stats

words = st.text("abcdé ", max_size=12)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert sim.lcs(a, b) == brute_lcs(a, b)
    assert 0 <= sim.indel(a, b) <= 1 and sim.indel(a, b) == pytest.approx(sim.indel(b, a))
    assert sim.partial(a, b) >= 0


def test_measures(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("same", "same"), (None, "x")], "a string, b string")
    got = df.select(sim.edit_ratio(F.col("a"), F.col("b")).alias("e"), sim.indel_ratio("a", "b").alias("i"), sim.block_ratio("a", "b").alias("s")).collect()
    assert got[0]["e"] == pytest.approx(1 - 3 / 7) and got[1]["e"] == 1 and got[2]["i"] == 1
    assert got[0]["s"] == SequenceMatcher(None, "kitten", "sitting", autojunk=False).ratio()
    assert got[3]["e"] is None and got[3]["i"] == 0


def test_text_forms(spark):
    df = spark.createDataFrame([(r"A $x^2$ \emph{big}  Title–s", "Dr. Élie Touzi ", "https://doi.org/10.5555/Ab.1.", "arXiv:2101.00042v3"), (None, None, None, None)], "t string, n string, d string, x string")
    r = df.select(tx.plain_latex("t").alias("p"), tx.title_form("t").alias("f"), tx.author_form("n").alias("a"), tx.doi("d").alias("d"), tx.arxiv("x").alias("x"), tx.folded("n").alias("z")).collect()
    assert r[0]["p"] == "A big Title–s" and r[0]["f"] == "a big title s" and r[0]["a"] == "élie touzi"
    assert r[0]["d"] == "10.5555/ab.1" and r[0]["x"]["base"] == "2101.00042" and r[0]["x"]["version"] == 3 and r[0]["z"].startswith("dr. elie")
    assert r[1]["p"] is None and r[1]["z"] is None


@given(st.lists(st.text("Aa-, –'’x", max_size=20), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_forms_are_stable(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f in (tx.spaces, tx.scoring_form, tx.ascii_form, tx.even_marks):
        assert df.where(f(f("t")) != f("t")).count() == 0


def test_one_edit_and_bands(spark):
    w = spark.createDataFrame([("cat",), ("cats",), ("act",), ("dog",)], "w string")
    n = spark.createDataFrame([("cat",), ("dot",)], "n string")
    assert {tuple(r) for r in joins.one_edit(w, "w", n, "n").collect()} == {("cats", "cat"), ("dog", "dot")}
    d = spark.createDataFrame([(i, "g", f"text number {i}") for i in range(30)], "id long, g string, t string")
    got = {tuple(r) for r in joins.band_pairs(d, "id", "g", "t", 3, 0.8).collect()}
    assert got == {(i, j) for i in range(30) for j in range(i + 1, min(i + 4, 30))}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "p string, id int, n int")
    new = spark.createDataFrame([("b", 9), ("c", 7)], "p string, n int")
    assert {tuple(r) for r in joins.upsert(old, new, "p", ["id"]).collect()} == {("a", 1, 5, "keep"), ("b", 2, 9, "update"), ("c", None, 7, "insert")}


def test_stats(spark):
    d = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", 7)], "g string, v long")
    assert {tuple(r) for r in stats.upper_median(d, "g", "v").collect()} == {("a", 3), ("b", 7)}
    e = spark.createDataFrame([("u", i, float(x)) for i, x in enumerate((1, 0, 4))], "g string, o int, v double")
    assert stats.exponential_average(e, "g", ["o"], "v", 0.3).first()["ema"] == pytest.approx((1 * 0.7 + 0) * 0.7 + 4 * 0.3)


def test_band_pairs_brute_force(spark):
    import random

    from quire.operators import joins

    rng = random.Random(3)
    texts = []
    for i in range(30):
        base = "".join(rng.choice("abcde fgh") for _ in range(rng.randrange(40, 90)))
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
    rows = [(i, "hot" if i % 3 else "cold", t) for i, t in enumerate(texts)] + [(900, None, "x"), (901, "hot", None), (902, "hot", "")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    truth = set()
    for g in ("hot", "cold"):
        own = [(i, t) for i, s, t in rows if s == g and t is not None]
        for k, (i, t) in enumerate(own):
            truth |= {(i, j) for j, u in own[k + 1 : k + 8] if t != u and distance(t, u) <= int(0.08 * max(len(t), len(u)) + 1e-9)}
    d = spark.createDataFrame(rows, "id long, source string, text string").repartition(5)
    assert {tuple(r) for r in joins.band_pairs(d, "id", "source", "text", 7, 0.92).collect()} == truth and len(truth) > 5
    assert joins.band_pairs(d.limit(0), "id", "source", "text", 7, 0.92).count() == 0
    assert [r["rn"] for r in joins.places(d, "id").orderBy("id").collect()] == list(range(len(rows)))


def test_bigram_bits_bound_edits(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcde fgh12") for _ in range(rng.randrange(50)))
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", " "])
        rows.append((a, "".join(b)))
    d = spark.createDataFrame([*rows, ("", ""), (None, "q")], "a string, b string").repartition(3)
    d = d.withColumns({"x": sim.bigram_bits("a"), "y": sim.bigram_bits("b"), "far": F.levenshtein("a", "b")}).where("a is not null").collect()
    assert len(d) == 301
    assert all(sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(r["x"], r["y"], strict=True)) <= 4 * r["far"] for r in d)
