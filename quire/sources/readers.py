"""Readers: directories, chat and plain JSON lines, word lists, bibliographies, feeds, provider records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_directory(spark: SparkSession, base: str, extensions: list[str], exclude: list[str] | None = None, hidden: bool = False, min_size: int = 0) -> DataFrame:
    """path, size and time of the files below ``base``; contents are not read (columns pruned). A missing base gives no rows."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", F.col("length").alias("size"), "modificationTime")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, size long, modificationTime timestamp")
    ok = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([x.lower() for x in extensions]) & (F.col("size") >= min_size)
    if not hidden:
        ok &= ~F.col("path").rlike(r"/\.[^/]+")
    for d in exclude or []:
        ok &= ~F.contains("path", F.lit(f"/{d}/"))
    return files.where(ok).dropDuplicates(["path"])


def first_files(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy("path").limit(n)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chats of at least three messages: title, authors (split at semicolons), text between the markers; bad lines are skipped."""
    shape = "messages array<struct<role:string,content:string>>"
    rows = spark.read.text(path).select(F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("m")).where(F.size("m.messages") >= 3).select("m.messages")
    answer = F.from_json(F.element_at("messages", -1)["content"], "title string, authors string")
    ask = F.element_at("messages", -2)["content"]
    inside = F.regexp_extract(ask, r"(?s)<text>(.*?)</text>", 1)
    return rows.select(answer["title"].alias("title"), F.transform(F.split(answer["authors"], ";"), lambda a: F.trim(a)).alias("authors"), F.when(inside != "", F.regexp_replace(inside, r"^\s+|\s+$", "")).otherwise(ask).alias("text"), "messages").where("title is not null")


def clean_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON that have a prompt that is not blank."""
    rows = spark.read.text(path).select("value", F.from_json("value", "prompt string").alias("j"))
    return rows.where("trim(j.prompt) <> ''").select("value", "j.prompt")


def read_words(spark: SparkSession, path: str, longest: int = 100) -> DataFrame:
    """Distinct words of a list with comments after ``#``."""
    w = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    return spark.read.text(path).select(w.alias("word")).where((F.col("word") != "") & (F.length("word") <= longest)).distinct()


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries with a title: kind, key, title, authors, year (null if it is no number), doi."""
    text = spark.read.text(path, wholetext=True)
    entry = text.select(F.explode(F.split("value", r"(?m)^\s*@")).alias("e")).where(F.col("e").rlike(r"^\w+\s*\{"))

    def field(name: str) -> Column:
        v = F.regexp_extract("e", rf'(?is)\b{name}\s*=\s*[{{"]+(.*?)["}}]+\s*,?\s*(?:\n|$)', 1)
        return F.when(F.trim(v) != "", F.trim(F.regexp_replace(F.regexp_replace(v, r"[{}]", ""), r"\s+", " ")))

    year = F.coalesce(field("year"), F.regexp_extract("e", r"(?i)\byear\s*=\s*(\d{4})", 1)).try_cast("int")
    cols = entry.select(F.lower(F.regexp_extract("e", r"^(\w+)", 1)).alias("kind"), F.regexp_extract("e", r"^\w+\s*\{\s*([^,\s]+)", 1).alias("key"), field("title").alias("title"), F.split(field("author"), r"\s+and\s+").alias("authors"), year.alias("year"), field("doi").alias("doi"))
    return cols.where("title is not null")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: id after ``/abs/``, title, authors (or Unknown), year."""
    text = spark.read.text(path, wholetext=True)
    e = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry>.*?</entry>"), 0)).alias("e"))
    title = F.trim(F.regexp_replace(F.xpath_string("e", F.lit("entry/title")), r"\s+", " "))
    authors = F.xpath("e", F.lit("entry/author/name/text()"))
    return e.select(F.regexp_extract(F.xpath_string("e", F.lit("entry/id")), r"/abs/(\S+)", 1).alias("id"), title.alias("title"), F.when(F.size(authors) > 0, authors).otherwise(F.array(F.lit("Unknown"))).alias("authors"), F.substring(F.xpath_string("e", F.lit("entry/published")), 1, 4).try_cast("int").alias("year"))


UNIFIED = ["title", "authors", "year", "doi", "venue", "source"]


def from_registry(df: DataFrame, json: str = "value") -> DataFrame:
    """Records of a DOI registry as unified rows."""
    j = F.from_json(json, "title array<string>, author array<struct<given:string,family:string>>, DOI string, `container-title` array<string>, issued struct<`date-parts`:array<array<int>>>")
    a = F.transform(j["author"], lambda x: F.concat_ws(" ", x["given"], x["family"]))
    return df.select(F.try_element_at(j["title"], F.lit(1)).alias("title"), F.coalesce(a, F.array().cast("array<string>")).alias("authors"), F.try_element_at(F.try_element_at(j["issued"]["date-parts"], F.lit(1)), F.lit(1)).alias("year"), F.lower(j["DOI"]).alias("doi"), F.try_element_at(j["container-title"], F.lit(1)).alias("venue"), F.lit("registry").alias("source"))


def from_graph(df: DataFrame, json: str = "value") -> DataFrame:
    """Records of a citation graph as unified rows."""
    j = F.from_json(json, "title string, year int, venue string, authors array<struct<name:string>>, externalIds struct<DOI:string>")
    return df.select(j["title"].alias("title"), F.coalesce(j["authors"]["name"], F.array().cast("array<string>")).alias("authors"), j["year"].alias("year"), F.lower(j["externalIds"]["DOI"]).alias("doi"), j["venue"].alias("venue"), F.lit("graph").alias("source"))


def unify(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*UNIFIED)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in an order that only the key and the seed decide."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The JSON lines of one split (train, validation, test) of a data set; a missing split gives no rows."""
    try:
        return spark.read.json(f"{folder}/{split}.jsonl").withColumn("split", F.lit(split))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "split string")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of dictionaries in YAML (a list of names with their variants, by language): language, canonical, variants.

    One file is one small dimension, so a file is parsed whole; entries without a canonical form are left out.
    """
    import yaml

    language = F.regexp_extract("path", r"([^/]+)\.ya?ml$", 1)
    files = spark.read.format("binaryFile").load(path).select(language.alias("language"), F.col("content").cast("string").alias("text"))
    shape = "language string, canonical string, variants array<string>"

    def entries(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for lang, text in zip(pdf["language"], pdf["text"], strict=True):
                top = yaml.safe_load(text) or []
                for e in top.values() if isinstance(top, dict) else top:
                    for one in e if isinstance(e, list) else [e]:
                        name = one.get("canonical") or one.get("name") if isinstance(one, dict) else str(one)
                        if name:
                            rows.append((lang, str(name), [str(v) for v in (one.get("variants") or [])] if isinstance(one, dict) else []))
            yield pd.DataFrame(rows, columns=["language", "canonical", "variants"])

    return files.mapInPandas(entries, shape)
