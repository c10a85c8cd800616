import json

import pytest

from quire.sources import readers, writers


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "skip").mkdir()
    for n, size in (("a/x.PDF", 10), ("a/y.txt", 10), ("skip/z.pdf", 10), (".h.pdf", 10), ("a/s.pdf", 1)):
        (tmp_path / n).write_bytes(b"x" * size)
    got = readers.scan_directory(spark, str(tmp_path), [".pdf"], exclude=["skip"], min_size=5)
    assert [r["path"].rsplit("/", 1)[1] for r in got.collect()] == ["x.PDF"]
    assert readers.scan_directory(spark, str(tmp_path / "none"), [".pdf"]).count() == 0
    assert readers.first_files(got, 0).count() == 0


def test_lines(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    chat = {"messages": [{"role": "s", "content": "x"}, {"role": "u", "content": "read <text>\nBody here\n</text>"}, {"role": "a", "content": json.dumps({"title": "T", "authors": "A; B"})}]}
    f.write_text(json.dumps(chat) + "\n\nbroken\n" + json.dumps({"messages": []}) + "\n")
    r = readers.read_chat(spark, str(f)).collect()
    assert len(r) == 1 and r[0]["title"] == "T" and r[0]["authors"] == ["A", "B"] and r[0]["text"] == "Body here"
    g = tmp_path / "p.jsonl"
    g.write_text('{"prompt": "x"}\n{"prompt": " "}\nno\n')
    assert readers.clean_prompts(spark, str(g)).count() == 1
    w = tmp_path / "w.txt"
    w.write_text("alpha # first\n\n# all\nbeta\nalpha\n")
    assert sorted(r["word"] for r in readers.read_words(spark, str(w)).collect()) == ["alpha", "beta"]


def test_bibliographies(spark, tmp_path):
    b = tmp_path / "x.bib"
    b.write_text("@article{k1,\n  title = {On {Things}},\n  author = {A B and C D},\n  year = {2020},\n  doi = {10.1/x}\n}\n@misc{k2,\n  author = {E}\n}\n@book{k3,\n title = \"Other\",\n year = {soon}\n}\n")
    r = {x["key"]: x for x in readers.read_bibtex(spark, str(b)).collect()}
    assert set(r) == {"k1", "k3"} and r["k1"]["authors"] == ["A B", "C D"] and r["k1"]["year"] == 2020 and r["k3"]["year"] is None
    a = tmp_path / "f.xml"
    a.write_text("<feed><entry><id>http://h/abs/2101.1v1</id><title>A\n title</title><published>2021-01-01</published><author><name>X</name></author></entry><entry><id>http://h/abs/2</id><title>B</title></entry></feed>")
    r = {x["id"]: x for x in readers.read_feed(spark, str(a)).collect()}
    assert r["2101.1v1"]["title"] == "A title" and r["2101.1v1"]["year"] == 2021 and r["2"]["authors"] == ["Unknown"]


def test_providers(spark):
    one = spark.createDataFrame([(json.dumps({"title": ["T"], "author": [{"given": "A", "family": "B"}], "DOI": "10.1/X", "issued": {"date-parts": [[2019, 2]]}}),), ("{}",)], "value string")
    two = spark.createDataFrame([(json.dumps({"title": "U", "year": 2018, "authors": [{"name": "C"}], "externalIds": {}}),)], "value string")
    u = readers.unify(readers.from_registry(one), readers.from_graph(two)).collect()
    assert [(r["title"], r["authors"], r["year"], r["doi"]) for r in u] == [("T", ["A B"], 2019, "10.1/x"), (None, [], None, None), ("U", ["C"], 2018, None)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"], None)], "i int, l array<string>, s string")
    assert tuple(writers.flat(d).first()) == ("1", "a; b", "")
    writers.write_lines(d, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").first()["l"] == ["a", "b"]
    for _ in range(2):
        writers.append_log(d, f"{tmp_path}/log", "b1")
    assert spark.read.json(f"{tmp_path}/log").count() == 1
    writers.write_report(d, f"{tmp_path}/r")
    assert writers.long_audit(d, ["i", "s"]).count() == 1


def test_splits_and_dictionaries(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"prompt": "a"}\n{"prompt": "b"}\n')
    assert readers.read_split(spark, str(tmp_path), "train").count() == 2 and readers.read_split(spark, str(tmp_path), "test").count() == 0
    pytest.importorskip("yaml")
    (tmp_path / "german.yaml").write_text("- canonical: Gauss, C. F.\n  variants: [Gauß, Gauss]\n- Hilbert\n- {variants: [x]}\n")
    got = {(r["language"], r["canonical"], tuple(r["variants"])) for r in readers.read_dictionary(spark, f"{tmp_path}/*.yaml").collect()}
    assert got == {("german", "Gauss, C. F.", ("Gauß", "Gauss")), ("german", "Hilbert", ())}
