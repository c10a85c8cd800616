import duckdb
import pytest

from quire.plans import catalogue

from .oracle import compare, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    compare(QUERIES[name](spark, small), connect(small).sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_scans_read_what_they_use(spark, small):
    plan = QUERIES["flt01_by_type"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(paper_type), EqualTo(paper_type,published)]" in plan
    assert "abstract" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["keep_id", "copies", "wasted_chars"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_preprints_meet_without_their_texts(spark, small):
    plan = QUERIES["j05_preprints"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert any("bit_count" in x and "levenshtein" not in x for x in joins)
    assert not any("Aggregate" in x and "ta#" in x for x in plan.splitlines())


def test_candidates_meet_by_word_and_name(spark, tables):
    papers = spark.createDataFrame([(1, "Ergodic lattices", '["Ann Lund", "Bo Stone"]'), (2, "Ergodic lattice", "[]"), (3, "Ergodic lattices", '["Cy Other"]')], "id long, title string, authors string")
    records = spark.createDataFrame([(7, "Ergodic Lattices", [None, "Lund, A."]), (8, "Ergodic lattices", []), (9, "Ergodic lattice", ["Other"])], "record_id long, title string, authors array<string>")
    at = tables(papers=papers, metadata_records=records)
    got = QUERIES["j11_best_candidate"](spark, at)
    compare(got, connect_folders(at).sql(SQL["j11_best_candidate"]))
    assert {r["record_id"]: r["paper_id"] for r in got.collect()} == {7: 1, 9: 3}
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert any("word#" in x and "family#" in x for x in joins)


def connect_folders(folder):
    c = duckdb.connect()
    for t in ("papers", "metadata_records"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return c
