"""Checks of file names and titles, spelling against dictionaries, scores of lines and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Characters that are not seen, kinds of security findings (kind, severity, pattern).
HIDDEN = "[​‌‍⁠﻿­‎‏‪-‮⁦-⁩]"
SECURITY = [
    ("dangerous_unicode", "critical", HIDDEN), ("path_traversal", "critical", r"\.\./|\.\.\\"), ("sql_injection", "critical", r"(?i)union\s+select|drop\s+table|insert\s+into\s|delete\s+from\s"),
    ("script_tag", "error", r"(?i)<script[^>]*>"), ("javascript_protocol", "error", r"(?i)javascript:"), ("event_handler", "error", r"(?i)[\s<]on[a-z]+\s*="), ("eval_call", "error", r"(?i)eval\s*\("), ("exec_call", "error", r"(?i)exec\s*\("),
]


def file_names(df: DataFrame, key: str, path: str) -> DataFrame:
    """The ordered report on each file name: its parts, ``messages``, whether it is ``valid``, and ``fixed`` (null if nothing changes)."""
    one = df.where(F.col(path).isNotNull()).select(key, F.regexp_extract(path, r"([^/]*)$", 1).alias("name")).withColumn("composed", tx.composed("name"))
    stem = F.regexp_replace("name", r"\.[A-Za-z0-9]{1,4}$", "")
    head = F.split_part("stem", F.lit(" - "), F.lit(1))
    one = one.withColumn("stem", stem).withColumn("parted", F.contains("stem", F.lit(" - ")))
    one = one.withColumn("author", F.trim(head)).withColumn("title", F.trim(F.substr(F.col("stem"), F.length(head) + 4)))
    odd = lambda a, b: F.regexp_count("stem", F.lit(a)) != F.regexp_count("stem", F.lit(b))
    has = lambda c, p: F.col(c).rlike(p)
    parted = F.col("parted")
    found = [
        (F.length("name") > 5000, "too long"), (has("name", HIDDEN), "hidden characters"), (F.col("composed") != F.col("name"), "not composed"), (~parted, "no separator"),
        (parted & ((F.col("author") == "") | (F.col("title") == "")), "empty part"), (parted & (F.col("author") != "") & ~has("author", r"^\p{Lu}[^,]*, \p{Lu}\."), "author form"),
        (has("name", r"\s\s"), "double space"), (parted & has("title", r"\p{L}- | -\p{L}"), "dash"), (odd(r"\(", r"\)") | odd(r"\[", r"\]"), "brackets"), (parted & has("title", r"^\p{Ll}"), "capital"),
    ]
    one = one.withColumn("messages", F.array_compact(F.array(*(F.when(c, m) for c, m in found))))
    fixed = tx.spaces(F.regexp_replace("composed", HIDDEN, ""))
    valid = ~F.arrays_overlap("messages", F.array(*map(F.lit, ["too long", "hidden characters", "no separator", "empty part"])))
    return one.withColumn("valid", F.when(F.size("messages") == 0, True).otherwise(valid)).withColumn("fixed", F.when(fixed != F.col("name"), fixed))


def suggestions(checked: DataFrame, key: str) -> DataFrame:
    """One row a suggestion for the report's messages: kind and confidence."""
    for_ = {"unicode": (0.95, ["hidden characters", "not composed"]), "spacing": (0.9, ["double space"]), "dash": (0.8, ["dash"]), "capital": (0.7, ["capital"])}
    some = lambda ms: reduce(lambda a, b: a | b, (F.array_contains("messages", m) for m in ms))
    each = F.array_compact(F.array(*(F.when(some(ms), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))) for k, (c, ms) in for_.items())))
    return checked.select(key, F.explode(each).alias("s")).select(key, "s.*")


def applied(checked: DataFrame, key: str) -> DataFrame:
    """The name after all suggestions, the surest first."""
    y = tx.spaces(F.regexp_replace("composed", HIDDEN, ""))
    y = F.when(F.array_contains("messages", "dash"), F.regexp_replace(F.regexp_replace(y, r"(\p{L})- ", "$1-"), r" -(\p{L})", "-$1")).otherwise(y)
    head = F.split_part(y, F.lit(" - "), F.lit(1))
    tail = F.substr(y, F.length(head) + 4)
    return checked.select(key, F.when(F.array_contains("messages", "capital"), F.concat(head, F.lit(" - "), F.upper(F.substring(tail, 1, 1)), F.substr(tail, F.lit(2)))).otherwise(y).alias("applied"))


def security(df: DataFrame, key: str, text: str, rules: list[tuple[str, str, str]] = SECURITY) -> DataFrame:
    """One row a finding: kind and severity; the rules are a setting of fixed size."""
    each = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(v).alias("severity"))) for k, v, p in rules)))
    return df.select(key, F.explode(each).alias("f")).select(key, "f.*")


def unpublished(df: DataFrame, day: str, age: int = 365) -> DataFrame:
    """Rows with an archive id, without a DOI, stored more than ``age`` days before ``day``."""
    no_doi = F.coalesce(F.trim("doi"), F.lit("")) == ""
    return df.where(no_doi & F.col("arxiv_id").isNotNull() & (F.substring("created_at", 1, 10).try_cast("date") < F.date_sub(F.lit(day).cast("date"), age)))


def relevance(df: DataFrame, allowed: list[str], denied: list[str]) -> DataFrame:
    """id, score and whether a denied word stands in title or abstract."""
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    some = lambda ws: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in ws), F.lit(False))
    score = 0.4 + F.least(F.regexp_count(F.coalesce("abstract", F.lit("")), F.lit(r"\S+")) / 200.0, F.lit(0.3)) + F.when(some(allowed), 0.2).otherwise(0.0)
    return df.select("id", score.alias("score"), some(denied).alias("denied"))


def standard(df: DataFrame, fields: dict[str, tuple[list[str], str | None]]) -> DataFrame:
    """Each standard field from the first of its columns that is filled, else its default; other columns stay."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return df.withColumns({k: F.coalesce(*(filled(c) for c in cs), F.lit(v)) for k, (cs, v) in fields.items()})


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a line, trimmed; ``k`` from 1."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("k", "line")).select(key, (F.col("k") + 1).cast("long").alias("k"), F.trim("line").alias("line"))


def capitals(line: Column) -> Column:
    """How many words begin with a capital."""
    return F.size(F.filter(F.split(line, " "), lambda w: w.rlike(r"^\p{Lu}")))


def title_score(line: Column, keywords: list[str], stops: list[str]) -> Column:
    low = F.lower(line)
    n = sum(F.contains(low, F.lit(w)).cast("int") for w in keywords)
    stop = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in stops))
    people = line.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+") & line.rlike(r", | and | & ")
    length = F.when(F.length(line).between(20, 200), 0.4).when(F.length(line).between(10, 300), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), length + F.least(F.lit(0.4), 0.15 * n) - F.when(stop, 0.5).otherwise(0.0) - F.when(people, 0.3).otherwise(0.0))


def title_like(title: Column, share: float, keywords: str) -> Column:
    return (capitals(title) > share * F.size(F.split(title, " "))) | F.lower(title).rlike(keywords)


def layout_confidence(title: str, authors: Column, abstract: str, template: str) -> Column:
    n = F.length(title)
    t = F.when(n.between(10, 250), 0.35).when(n.between(5, 300), 0.2).when(F.col(title).isNull(), 0.05).otherwise(0.0)
    return t + F.when(authors > 0, 0.2).otherwise(0.05) + F.when(authors >= 2, 0.05).otherwise(0.0) + F.when(F.col(abstract).isNotNull(), 0.1).otherwise(0.0) + F.when(F.col(template).isNotNull(), 0.05).otherwise(0.0)


def unknown_words(df: DataFrame, key: str, text: str, dictionaries: list[DataFrame], least: int = 3) -> DataFrame:
    """Words of ``text`` outside formulas that no dictionary (column ``word``) has."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\$[^$]*\$", " "), F.lit(r"\p{L}+"), 0)
    out = df.select(key, F.explode(F.array_distinct(words)).alias("word")).where(F.length("word") >= least).distinct()
    unknown = out.select("word").distinct()
    for d in dictionaries:  # each word is looked up once, however often it stands
        unknown = unknown.join(d.select("word").distinct(), "word", "left_anti")
    return out.join(unknown, "word", "left_semi").select(key, "word")


def misspelled(df: DataFrame, key: str, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """"found -> correction" for each rule that a text breaks."""
    each = F.array_compact(F.array(*(F.when(F.lower(text).rlike(rf"(^|[^\p{{L}}]){a}($|[^\p{{L}}])"), f"{a} -> {b}") for a, b in rules)))
    return df.select(key, F.explode(each).alias("error"))


def language(text: Column, indicators: dict[str, list[str]]) -> Column:
    """The language with most indicator words among a text's words; the first of equals."""
    ws = F.array_distinct(F.split(F.lower(text), r"\s+"))
    n = {k: F.size(F.array_intersect(ws, F.array(*map(F.lit, v)))) for k, v in indicators.items()}
    top = F.greatest(*n.values())
    return F.coalesce(*(F.when(c == top, F.lit(k)) for k, c in n.items()))


def spelling_form(c: str, longest: int = 200) -> Column:
    y = tx.spaces(F.regexp_replace(tx.folded(F.regexp_replace(c, "[™®©]", "")), r"[^a-z0-9 -]", ""))
    return F.substring(F.regexp_replace(y, r"^-+|-+$", ""), 1, longest)


def advanced_clean(c: str) -> Column:
    """No control characters, even spaces."""
    return tx.spaces(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def ambiguous(names: DataFrame, name: str, most: int) -> DataFrame:
    """Names that have variants of the same letters, or a family name that more than ``most`` names share."""
    n = names.select(name, F.lower(tx.family(F.col(name))).alias("family"), F.lower(F.regexp_replace(name, r"[^\p{L}]", "")).alias("form"))
    families, forms = n.groupBy("family").agg(F.count("*").alias("k")), n.groupBy("form").agg(F.count("*").alias("v"))
    j = n.join(families, "family").join(forms, "form").where((F.col("v") > 1) | (F.col("k") > most))
    return j.select(name, F.when(F.col("v") > 1, "variants").otherwise("frequent family name").alias("ambiguity"))


def empty_examples(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``n`` seeded examples of texts without content."""
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))
    junk = F.when(h < "5", "").when(h < "a", "[no text]").otherwise(F.concat(F.lit("page "), (F.col("doc_id") % 97).cast("string")))
    return spark.range(1, n + 1).select(F.col("id").alias("doc_id"), h.alias("seed"), junk.alias("junk"))
