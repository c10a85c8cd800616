"""Checks of file names and titles, spelling with dictionaries, extractors by site, maintenance (FLT, X, Y and S of the inventory).

Dictionaries, rules and thresholds are inputs of the functions; the queries bind them to the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import checks
from ..session import table
from .registry import Plans

plan = Plans()


def papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


def scans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").where("text_extract is not null")


HIDDEN = "​‌‍⁠﻿­‎‏‪‫‬‭‮⁦⁧⁨⁩"
NAMED = rf"""with f as (select id, regexp_extract(file_path, '([^/]*)$', 1) b from papers where file_path is not null),
  g as (select id, b, regexp_replace(b, '\.[A-Za-z0-9]{{1,4}}$', '') stem, regexp_extract(b, '(\.[A-Za-z0-9]{{1,4}})$', 1) ext from f),
  h as (select *, contains(stem, ' - ') parted, trim(split_part(stem, ' - ', 1)) author, trim(substr(stem, length(split_part(stem, ' - ', 1)) + 4)) title from g),
  i as (select *, trim(regexp_replace(regexp_replace(nfc_normalize(b), '[{HIDDEN}]', '', 'g'), '\s+', ' ', 'g')) fixed from h),
  m as (select *, list_filter([
    case when length(b) > 5000 then 'too long' end, case when regexp_matches(b, '[{HIDDEN}]') then 'hidden characters' end, case when nfc_normalize(b) <> b then 'not composed' end,
    case when not parted then 'no separator' end, case when parted and (author = '' or title = '') then 'empty part' end,
    case when parted and author <> '' and not regexp_matches(author, '^\p{{Lu}}[^,]*, \p{{Lu}}\.') then 'author form' end,
    case when regexp_matches(b, '\s\s') then 'double space' end, case when parted and regexp_matches(title, '\p{{L}}- | -\p{{L}}') then 'dash' end,
    case when length(replace(stem, '(', '')) <> length(replace(stem, ')', '')) or length(replace(stem, '[', '')) <> length(replace(stem, ']', '')) then 'brackets' end,
    case when parted and regexp_matches(title, '^\p{{Ll}}') then 'capital' end], lambda x: x is not null) messages from i)"""


@plan(NAMED + " select id, array_to_string(messages, '; ') messages, not list_has_any(messages, ['too long', 'hidden characters', 'no separator', 'empty part']) as valid, case when fixed <> b then fixed end as fixed from m")
def x01_file_names(s: SparkSession, d: str) -> DataFrame:
    """The whole check of every file name as one ordered report."""
    return checks.file_names(papers(s, d), "id", "file_path").select("id", F.array_join("messages", "; ").alias("messages"), "valid", "fixed")


@plan(NAMED + " select id, array_to_string(messages, '; ') messages, case when fixed <> b and split_part(fixed, ' - ', 1) <> split_part(b, ' - ', 1) then split_part(fixed, ' - ', 1) end as fixed_author from m where len(messages) > 0")
def flt08_flagged_names(s: SparkSession, d: str) -> DataFrame:
    c = checks.file_names(papers(s, d), "id", "file_path").where(F.size("messages") > 0)
    first = lambda x: F.split_part(x, F.lit(" - "), F.lit(1))
    return c.select("id", F.array_join("messages", "; ").alias("messages"), F.when(first(F.col("fixed")) != first(F.col("name")), first(F.col("fixed"))).alias("fixed_author"))


SUGGESTED = NAMED + """, u as (select id, b, unnest([
    {'kind': 'unicode', 'confidence': 0.95, 'ok': list_has_any(messages, ['hidden characters', 'not composed'])}, {'kind': 'spacing', 'confidence': 0.9, 'ok': list_contains(messages, 'double space')},
    {'kind': 'dash', 'confidence': 0.8, 'ok': list_contains(messages, 'dash')}, {'kind': 'capital', 'confidence': 0.7, 'ok': list_contains(messages, 'capital')}]) k from m)"""


@plan(SUGGESTED + " select id, k.kind as kind, k.confidence::double as confidence from u where k.ok")
def x12_suggestions(s: SparkSession, d: str) -> DataFrame:
    return checks.suggestions(checks.file_names(papers(s, d), "id", "file_path"), "id").select("id", "kind", "confidence")


@plan(NAMED + rf"""select id, c.c as applied from m, lateral (select nfc_normalize(regexp_replace(b, '[{HIDDEN}]', '', 'g')) u) u, lateral (select trim(regexp_replace(u.u, '\s+', ' ', 'g')) w) w,
  lateral (select case when list_contains(messages, 'dash') then regexp_replace(regexp_replace(w.w, '(\p{{L}})- ', '\1-', 'g'), ' -(\p{{L}})', '-\1', 'g') else w.w end y) y,
  lateral (select case when list_contains(messages, 'capital') then concat(split_part(y.y, ' - ', 1), ' - ', upper(substr(y.y, length(split_part(y.y, ' - ', 1)) + 4, 1)), substr(y.y, length(split_part(y.y, ' - ', 1)) + 5)) else y.y end c) c where len(messages) > 0""")
def x12_applied(s: SparkSession, d: str) -> DataFrame:
    """All suggestions applied in the order of their confidence."""
    return checks.applied(checks.file_names(papers(s, d), "id", "file_path").where(F.size("messages") > 0), "id")


def _issues(origin: str, key: str, text: str, source: str) -> str:
    rows = ", ".join(f"('{k}', '{v}', '{p}')" for k, v, p in checks.SECURITY)
    return f"select '{origin}' as origin, {key}::bigint as id, r.kind, r.severity from {source} x, (values {rows}) r(kind, severity, pattern) where regexp_matches(x.{text}, r.pattern)"


@plan(_issues("papers", "id", "title", "papers") + " union all " + _issues("documents", "doc_id", "text", "documents"))
def flt15_security(s: SparkSession, d: str) -> DataFrame:
    a = checks.security(papers(s, d), "id", "title").select(F.lit("papers").alias("origin"), "id", "kind", "severity")
    return a.unionByName(checks.security(docs(s, d), "doc_id", "text").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "kind", "severity"))


@plan(NAMED + rf""", v as (select id, list_filter([case when not parted then 'format' end, case when parted and not regexp_matches(author, '\p{{L}}{{2}}') then 'authors' end, case when parted and (length(title) < 5 or not regexp_matches(title, '\p{{L}}{{3}}')) then 'title' end,
  case when regexp_matches(b, '[{HIDDEN}]') then 'hidden characters' end], lambda x: x is not null) e, nfc_normalize(b) <> b w from m) select id, len(e) = 0 as valid, array_to_string(e, '; ') as errors, w as warned from v""")
def y26_academic_name(s: SparkSession, d: str) -> DataFrame:
    c = checks.file_names(papers(s, d), "id", "file_path")
    has = lambda p: F.coalesce(F.col("title").rlike(p), F.lit(False))
    errors = F.array_compact(F.array(F.when(~F.col("parted"), "format"), F.when(F.col("parted") & ~F.col("author").rlike(r"\p{L}{2}"), "authors"), F.when(F.col("parted") & ((F.length("title") < 5) | ~has(r"\p{L}{3}")), "title"), F.when(F.array_contains("messages", "hidden characters"), "hidden characters")))
    return c.select("id", (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), F.array_contains("messages", "not composed").alias("warned"))


@plan("select arxiv_id, id from papers where nullif(trim(coalesce(doi, '')), '') is null and arxiv_id is not null and cast(left(created_at, 10) as date) < date '2023-01-01' - interval 365 day")
def flt11_unpublished(s: SparkSession, d: str) -> DataFrame:
    """Working papers older than a year, as of a day that is a parameter."""
    return checks.unpublished(papers(s, d), "2023-01-01").select("arxiv_id", "id")


@plan(r"""with t as (select id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) t, len(regexp_extract_all(coalesce(abstract, ''), '\S+')) n from papers), v as (select id, contains(t, 'withdrawn') or contains(t, 'corrigendum') denied,
  0.4 + least(n / 200.0, 0.3) + case when contains(t, 'stochastic') or contains(t, 'ergodic') then 0.2 else 0.0 end score from t) select id, round(score, 4) as score from v where not denied and score >= 0.6""")
def flt07_threshold(s: SparkSession, d: str) -> DataFrame:
    scored = checks.relevance(papers(s, d), ["stochastic", "ergodic"], ["withdrawn", "corrigendum"])
    return scored.where("not denied and score >= 0.6").select("id", F.round("score", 4).alias("score"))


FORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@plan(f"select c.file_path, {FORM.format('c.t')} = {FORM.format('p.title')} as exact from (select file_path, json_extract_string(metadata, '$.title') t from pdf_cache) c join papers p using (file_path) where t is not null and title is not null")
def s05_title_exact(s: SparkSession, d: str) -> DataFrame:
    norm = lambda c: tx.spaces(tx.sub(F.lower(F.col(c)), r"[^\p{L}\p{N}_\s]", ""))
    got = table(s, d, "pdf_cache").select("file_path", F.get_json_object("metadata", "$.title").alias("t")).where("t is not null")
    return got.join(papers(s, d).where("title is not null").select("file_path", "title"), "file_path").select("file_path", (norm("t") == norm("title")).alias("exact"))


@plan("select id, coalesce(nullif(trim(title), ''), 'Unknown') as title, coalesce(nullif(trim(doi), ''), nullif(trim(arxiv_id), '')) as identifier, coalesce(nullif(trim(journal), ''), nullif(trim(source), ''), 'unknown') as origin, coalesce(file_size, 0) as size from papers")
def y05_standard_fields(s: SparkSession, d: str) -> DataFrame:
    return checks.standard(papers(s, d), {"title": (["title"], "Unknown"), "identifier": (["doi", "arxiv_id"], None), "origin": (["journal", "source"], "unknown")}).select("id", "title", "identifier", "origin", F.coalesce("file_size", F.lit(0)).alias("size"))


@plan("select library_used as method, count(*) as processed, count(*) filter (coalesce(text_extract, '') <> '') as done, count(*) filter (coalesce(text_extract, '') = '') as failed, coalesce(list_sort(list(file_path) filter (coalesce(text_extract, '') = '')), []) as errors from pdf_cache group by 1")
def y07_outcomes(s: SparkSession, d: str) -> DataFrame:
    bad = F.coalesce("text_extract", F.lit("")) == ""
    c = table(s, d, "pdf_cache").groupBy(F.col("library_used").alias("method"))
    return c.agg(F.count("*").alias("processed"), F.count_if(~bad).alias("done"), F.count_if(bad).alias("failed"), F.array_sort(F.collect_list(F.when(bad, F.col("file_path")))).alias("errors"))


@plan(NAMED + r""" select id, case when parted then title else stem end as title, case when parted then len(list_filter(regexp_split_to_array(author, '\s+and\s+|,\s*'), lambda x: trim(x) <> '')) else 0 end as authors,
  nullif(regexp_extract(stem, '(\d{4}\.\d{4,5})', 1), '') as arxiv_id, nullif(regexp_extract(stem, '(?:^|[^0-9A-Za-z_])((?:19|20)\d\d)(?:$|[^0-9A-Za-z_])', 1), '') as year from m""")
def y09_from_name(s: SparkSession, d: str) -> DataFrame:
    c = checks.file_names(papers(s, d), "id", "file_path")
    some = lambda p: F.when(F.regexp_extract("stem", p, 1) != "", F.regexp_extract("stem", p, 1))
    people = F.size(F.filter(F.split("author", r"\s+and\s+|,\s*"), lambda x: F.trim(x) != ""))
    return c.select("id", F.when(F.col("parted"), F.col("title")).otherwise(F.col("stem")).alias("title"), F.when(F.col("parted"), people).otherwise(0).cast("long").alias("authors"), some(r"(\d{4}\.\d{4,5})").alias("arxiv_id"), some(r"(?:^|[^0-9A-Za-z_])((?:19|20)\d\d)(?:$|[^0-9A-Za-z_])").alias("year"))


LINES = r"with l as (select file_path, k, trim(string_split(text_extract, chr(10))[k]) line from pdf_cache, unnest(range(1, 1 + len(string_split(text_extract, chr(10))))) t(k) where text_extract is not null)"
PERSON = r"[A-Z][a-z]+\s+[A-Z][a-z]+"


@plan(LINES + rf" select file_path, min_by(line, k) as authors, 0.7::double as confidence from l where k <= 10 and length(line) between 5 and 200 and regexp_matches(line, '^{PERSON}(,\s*{PERSON}|\s+and\s+{PERSON})*$|^[A-Z]\.\s*[A-Z][a-z]+') group by 1")
def y11_author_line(s: SparkSession, d: str) -> DataFrame:
    lines = checks.lines(scans(s, d), "file_path", "text_extract").where("k <= 10 and length(line) between 5 and 200")
    named = lines.where(F.col("line").rlike(rf"^{PERSON}(,\s*{PERSON}|\s+and\s+{PERSON})*$|^[A-Z]\.\s*[A-Z][a-z]+"))
    return named.groupBy("file_path").agg(F.min_by("line", "k").alias("authors")).withColumn("confidence", F.lit(0.7))


@plan(LINES + r""", q as (select file_path, k, line, lower(line) w from l where k <= 20 and line <> ''), v as (select file_path, k, line, greatest(0.0, case when length(line) between 20 and 200 then 0.4 when length(line) between 10 and 300 then 0.2 else 0.0 end
  + least(0.4, 0.15 * (contains(w, 'analysis')::int + contains(w, 'approach')::int + contains(w, 'method')::int + contains(w, 'theory')::int + contains(w, 'application')::int)) - case when contains(w, 'abstract') or contains(w, 'journal') then 0.5 else 0.0 end
  - case when regexp_matches(line, '[A-Z][a-z]+\s+[A-Z][a-z]+') and regexp_matches(line, ', | and | & ') then 0.3 else 0.0 end) score from q)
  select file_path, line as title, round(score, 4) as score from v qualify row_number() over (partition by file_path order by round(score, 4) desc, k) = 1""")
def y12_title_line(s: SparkSession, d: str) -> DataFrame:
    """The best title line of the first twenty by length, words of the field, stop words and likeness to author lines."""
    l = checks.lines(scans(s, d), "file_path", "text_extract").where("k <= 20 and line <> ''")  # noqa: E741
    scored = l.withColumn("score", F.round(checks.title_score(F.col("line"), ["analysis", "approach", "method", "theory", "application"], ["abstract", "journal"]), 4))
    best = scored.groupBy("file_path").agg(F.max_by(F.struct("line", "score"), F.struct("score", -F.col("k"))).alias("v"))
    return best.select("file_path", F.col("v.line").alias("title"), "v.score")


@plan(r"""with t as (select id, trim(regexp_replace(regexp_replace(regexp_replace(title, 'arXiv:\S+', '', 'g'), '\[[a-z-]+(\.[A-Z]{2})?\]', '', 'g'), '\s+', ' ', 'g')) t from papers where title is not null)
  select id, t as title, len(list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '^\p{Lu}'))) > 0.3 * len(string_split(t, ' ')) or regexp_matches(lower(t), 'theorem|estimates|approach|remarks') as title_like from t""")
def y13_archive_titles(s: SparkSession, d: str) -> DataFrame:
    t = tx.spaces(tx.sub(tx.sub("title", r"arXiv:\S+"), r"\[[a-z-]+(\.[A-Z]{2})?\]"))
    p = papers(s, d).where("title is not null").select("id", t.alias("title"))
    return p.select("id", "title", checks.title_like(F.col("title"), 0.3, r"theorem|estimates|approach|remarks").alias("title_like"))


@plan(LINES + r""" select file_path, k as line_no, case when regexp_matches(line, '(?i)vol\.|journal|issn|doi|copyright') then 'metadata' when regexp_matches(line, '[A-Z][a-z]+\s+[A-Z][a-z]+,') or regexp_matches(line, '^[A-Z]\.\s*[A-Z][a-z]+(\s+and\s+|,)') then 'authors'
  when len(list_filter(string_split(line, ' '), lambda x: regexp_matches(x, '^\p{Lu}'))) > 0.4 * len(string_split(line, ' ')) then 'title' else 'text' end as kind from l where k <= 15 and line <> ''""")
def y14_journal_lines(s: SparkSession, d: str) -> DataFrame:
    l = checks.lines(scans(s, d), "file_path", "text_extract").where("k <= 15 and line <> ''")  # noqa: E741
    line = F.col("line")
    kind = F.when(line.rlike(r"(?i)vol\.|journal|issn|doi|copyright"), "metadata").when(line.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+,") | line.rlike(r"^[A-Z]\.\s*[A-Z][a-z]+(\s+and\s+|,)"), "authors").when(checks.capitals(line) > 0.4 * F.size(F.split(line, " ")), "title").otherwise("text")
    return l.select("file_path", F.col("k").alias("line_no"), kind.alias("kind"))


CONF = "case when length(title) between 10 and 250 then 0.35 when length(title) between 5 and 300 then 0.2 when title is null then 0.05 else 0.0 end + case when a > 0 then 0.2 else 0.05 end + case when a >= 2 then 0.05 else 0.0 end + case when abstract is not null then 0.1 else 0.0 end + case when journal is not null then 0.05 else 0.0 end"
PEOPLE = """len(from_json(coalesce(nullif(authors, ''), '[]'), '["VARCHAR"]'))"""


@plan(f"select id, round({CONF}, 4) as confidence from (select *, {PEOPLE} a from papers)")
def y18_layout_confidence(s: SparkSession, d: str) -> DataFrame:
    a = F.coalesce(F.size(F.from_json(F.col("authors"), "array<string>")), F.lit(0))
    return papers(s, d).select("id", F.round(checks.layout_confidence("title", a, "abstract", "journal"), 4).alias("confidence"))


@plan(f"select id, round((case when t >= 0.35 then 0.9 else 0.5 end + case when a > 0 then 0.8 else 0.1 end) / 2, 4) as confidence from (select id, {PEOPLE} a, case when length(title) between 10 and 250 then 0.35 else 0.0 end t from papers)")
def y15_site_confidence(s: SparkSession, d: str) -> DataFrame:
    """The mean of the confidence in the title and that in the authors."""
    a = F.coalesce(F.size(F.from_json(F.col("authors"), "array<string>")), F.lit(0))
    t = F.when(F.length("title").between(10, 250), 0.9).otherwise(0.5)
    return papers(s, d).select("id", F.round((t + F.when(a > 0, 0.8).otherwise(0.1)) / 2, 4).alias("confidence"))


@plan(r"""select id, left(case when regexp_matches(substr(title, 16), '\s[A-Z][a-z]+ [A-Z][a-z]+,') then left(title, 15) || regexp_extract(substr(title, 16), '^(.*?)\s[A-Z][a-z]+ [A-Z][a-z]+,', 1) else title end, 300) as title from papers where title is not null""")
def y19_title_cut(s: SparkSession, d: str) -> DataFrame:
    """A title ends before the first name that follows a least length."""
    rest, name = F.substr(F.col("title"), F.lit(16)), r"\s[A-Z][a-z]+ [A-Z][a-z]+,"
    t = F.when(rest.rlike(name), F.concat(F.substring("title", 1, 15), F.regexp_extract(rest, rf"^(.*?){name}", 1))).otherwise(F.col("title"))
    return papers(s, d).where("title is not null").select("id", F.substring(t, 1, 300).alias("title"))


@plan(f"""select p.id, round(least(1.0, 0.5 + case when length(title) > 10 then 0.1 else 0.0 end + case when {PEOPLE} > 0 then 0.1 else 0.0 end + case when arxiv_id is not null then 0.2 else 0.0 end + case when abstract is not null then 0.1 else 0.0 end
  + case when doi is not null then 0.1 else 0.0 end + case when q > 0.7 then 0.1 when q > 0.5 then 0.05 else 0.0 end), 4) as confidence from papers p left join (select file_path, quality_score q from pdf_cache) using (file_path)""")
def y20_final_confidence(s: SparkSession, d: str) -> DataFrame:
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    a = F.coalesce(F.size(F.from_json(F.col("authors"), "array<string>")), F.lit(0))
    p = papers(s, d).join(table(s, d, "pdf_cache").select("file_path", F.col("quality_score").alias("q")), "file_path", "left")
    x = 0.5 + one(F.length("title") > 10, 0.1) + one(a > 0, 0.1) + one(F.col("arxiv_id").isNotNull(), 0.2) + one(F.col("abstract").isNotNull(), 0.1) + one(F.col("doi").isNotNull(), 0.1) + F.when(F.col("q") > 0.7, 0.1).when(F.col("q") > 0.5, 0.05).otherwise(0.0)
    return p.select("id", F.round(F.least(F.lit(1.0), x), 4).alias("confidence"))


@plan(LINES + r""" select file_path, min_by(line, k) as title from l where k <= 10 and length(line) between 10 and 300 and length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 0.7 * length(line) and not regexp_matches(lower(line), 'page|vol\.|arxiv|doi') group by 1""")
def y21_first_line(s: SparkSession, d: str) -> DataFrame:
    l = checks.lines(scans(s, d), "file_path", "text_extract").where("k <= 10 and length(line) between 10 and 300")  # noqa: E741
    ok = (F.length(F.regexp_replace("line", r"[^\p{L}]", "")) >= 0.7 * F.length("line")) & ~F.lower("line").rlike(r"page|vol\.|arxiv|doi")
    return l.where(ok).groupBy("file_path").agg(F.min_by("line", "k").alias("title"))


@plan(r"""with k as (select distinct unnest(regexp_extract_all(lower(text), '\p{L}+')) w from documents), a as (select distinct unnest(regexp_extract_all(lower(authors), '\p{L}+')) w from papers),
  t as (select distinct id, unnest(regexp_extract_all(regexp_replace(lower(title), '\$[^$]*\$', ' ', 'g'), '\p{L}+')) w from papers) select id, w as word from t where length(w) >= 3 and w not in (select w from k where w is not null) and w not in (select w from a where w is not null)""")
def y24_title_errors(s: SparkSession, d: str) -> DataFrame:
    """Words of titles that are in none of the dictionaries; formulas left out."""
    each = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0)).alias("word"))
    return checks.unknown_words(papers(s, d), "id", "title", [each(docs(s, d), "text"), each(papers(s, d), "authors")])


RULES = [("teh", "the"), ("recieve", "receive"), ("seperate", "separate"), ("occured", "occurred"), ("uniquenesss", "uniqueness"), ("stabilty", "stability")]


@plan("select id, r.found || ' -> ' || r.right_ as error from papers p, (values " + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + r") r(found, right_) where regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '(^|[^\p{L}])' || r.found || '($|[^\p{L}])')")
def y28_misspelled(s: SparkSession, d: str) -> DataFrame:
    return checks.misspelled(papers(s, d), "id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))), RULES)


INDICATORS = {"en": ["the", "and", "of", "with", "for"], "de": ["der", "die", "und", "das", "mit"], "fr": ["le", "la", "les", "des", "et"]}


@plan("with t as (select doc_id, " + ", ".join(f"len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), {ws})) as {k}" for k, ws in INDICATORS.items()) + " from documents where text is not null) select doc_id, case when en >= de and en >= fr then 'en' when de >= fr then 'de' else 'fr' end as language from t")
def y27_language(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", checks.language(F.col("text"), INDICATORS).alias("language"))


@plan(r"select id, left(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(title, '[™®©]', '', 'g'))), '[^a-z0-9 -]', '', 'g'), '\s+', ' ', 'g')), '^-+|-+$', '', 'g'), 200) as form from papers where regexp_matches(title, '^[\x00-\x7F]*$')")
def n06_spelling_form(s: SparkSession, d: str) -> DataFrame:
    """Letters, digits and inner hyphens only, in lower case without accents; the SQL has no such folding, so it holds ASCII titles."""
    return papers(s, d).where(F.col("title").rlike(r"^[\x00-\x7F]*$")).select("id", checks.spelling_form("title").alias("form"))


@plan(r"select doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) as text from documents where regexp_matches(text, '^[\x00-\x7F]*$')")
def y32_advanced_clean(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).where(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", checks.advanced_clean("text").alias("text"))


@plan(r"""select id, case when regexp_matches(lower(trim(doi)), '^(doi:|https?://(dx\.)?doi\.org/)?10\.') then 'doi' when regexp_matches(arxiv_id, '^(\d{4}\.\d{4,5}|[a-z-]+/\d{7})') then 'arxiv' when title is not null then 'title' else 'none' end as route from papers""")
def y34_route(s: SparkSession, d: str) -> DataFrame:
    """By which kind of identifier a record is looked up."""
    return papers(s, d).select("id", F.when(F.lower(F.trim("doi")).rlike(r"^(doi:|https?://(dx\.)?doi\.org/)?10\."), "doi").when(F.col("arxiv_id").rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+/\d{7})"), "arxiv").when(F.col("title").isNotNull(), "title").otherwise("none").alias("route"))


@plan("select file_hash, id as best_id, round(c, 6) as confidence from (select *, case when confidence > 1 then confidence / 100 else confidence end c from papers where file_hash is not null and confidence is not null and not isnan(confidence)) qualify row_number() over (partition by file_hash order by c desc, id) = 1")
def y34_best_of_sources(s: SparkSession, d: str) -> DataFrame:
    """Of what several sources say of one file, the answer with the highest confidence."""
    p = papers(s, d).where("file_hash is not null and confidence is not null and not isnan(confidence)").withColumn("c", F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")))
    return p.groupBy("file_hash").agg(F.max_by(F.struct("id", "c"), F.struct("c", -F.col("id"))).alias("v")).select("file_hash", F.col("v.id").alias("best_id"), F.round("v.c", 6).alias("confidence"))


@plan(r"""select doc_id, w as word, count(*) as n from (select doc_id, unnest(list_concat(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*'), list_filter(regexp_extract_all(array_to_string(list_filter(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*'), lambda x: contains(x, '-')), ' '), '\p{L}+'), lambda x: true))) w from documents where text is not null) where length(w) between 1 and 50 group by all""")
def y37_words(s: SparkSession, d: str) -> DataFrame:
    """Words, hyphens kept, and the parts of hyphenated ones."""
    whole = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:-\p{L}+)*"), 0)
    parts = F.flatten(F.transform(F.filter(whole, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    return docs(s, d).select("doc_id", F.explode(F.concat(whole, parts)).alias("word")).where("length(word) between 1 and 50").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@plan(r"""with n as (select distinct unnest(from_json(authors, '["VARCHAR"]')) name from papers), f as (select name, lower(case when contains(name, ',') then trim(split_part(name, ',', 1)) else regexp_extract(trim(name), '(\S+)$', 1) end) family, lower(regexp_replace(name, '[^\p{L}]', '', 'g')) form from n where trim(name) <> ''),
  c as (select family, count(*) k from f group by 1), v as (select form, count(*) k from f group by 1) select name, case when v.k > 1 then 'variants' when c.k > 5 then 'frequent family name' end as ambiguity from f join c using (family) join v using (form) where v.k > 1 or c.k > 5""")
def y38_ambiguous_names(s: SparkSession, d: str) -> DataFrame:
    n = papers(s, d).select(F.explode(F.from_json("authors", "array<string>")).alias("name")).where("trim(name) <> ''").distinct()
    return checks.ambiguous(n, "name", 5)


@plan("select count(*) as files, count(*) filter (coalesce(file_size, 0) = 0 or file_hash is null) as invalid, (select count(*) from (select 1 from papers where file_hash is not null group by lower(file_hash) having count(*) > 1)) as duplicate_groups from papers")
def y41_audit(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d)
    groups = p.where("file_hash is not null").groupBy(F.lower("file_hash").alias("h")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    return p.agg(F.count("*").alias("files"), F.count_if((F.coalesce("file_size", F.lit(0)) == 0) | F.col("file_hash").isNull()).alias("invalid")).join(F.broadcast(groups))  # two rows of totals


@plan(r"""select id, len(list_filter(from_json(coalesce(nullif(authors, ''), '[]'), '["VARCHAR"]'), lambda x: trim(x) <> '')) as authors, coalesce(from_json(nullif(research_areas, ''), '["VARCHAR"]')[1], 'none') as first_category, try_cast(regexp_extract(publication_date, '^(\d{4}-\d\d-\d\d)', 1) as date)::varchar as day from papers""")
def y42_parsed_fields(s: SparkSession, d: str) -> DataFrame:
    a = F.coalesce(F.size(F.filter(F.from_json(F.col("authors"), "array<string>"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    day = F.regexp_extract("publication_date", r"^(\d{4}-\d\d-\d\d)", 1)
    return papers(s, d).select("id", a.alias("authors"), F.coalesce(F.get(F.from_json("research_areas", "array<string>"), 0), F.lit("none")).alias("first_category"), F.when(day != "", day.try_cast("date")).cast("string").alias("day"))


@plan(f"""with u as (select 1 as ord, id::bigint as id, title, source, {FORM.format('title')} k from papers where title is not null union all select 2, record_id, title, source, {FORM.format('title')} from metadata_records where title is not null),
  o as (select k, first(ord order by ord, id) as origin, first(id order by ord, id) as id, count(*) as sources, count(distinct source) as providers from u where k <> '' group by k) select o.origin, o.id, o.sources, o.providers, r.cited from o left join (select {FORM.format('title')} k, max(citation_count) cited from metadata_records where title is not null group by 1) r using (k)""")
def y43_all_sources(s: SparkSession, d: str) -> DataFrame:
    """The union of all sources: of each title the first record, with what the providers add."""
    k = tx.spaces(tx.sub(F.lower("title"), r"[^\p{L}\p{N}_\s]", "")).alias("k")
    r = table(s, d, "metadata_records").where("title is not null")
    u = papers(s, d).where("title is not null").select(F.lit(1).alias("ord"), "id", "source", k).unionByName(r.select(F.lit(2).alias("ord"), F.col("record_id").alias("id"), "source", k)).where("k <> ''")
    one = u.groupBy("k").agg(F.min(F.struct("ord", "id")).alias("v"), F.count("*").alias("sources"), F.count_distinct("source").alias("providers"))
    return one.join(r.groupBy(k).agg(F.max("citation_count").alias("cited")), "k", "left").select(F.col("v.ord").alias("origin"), "v.id", "sources", "providers", "cited")


@plan("select doc_id, md5(doc_id::varchar || ':7') as seed, case when md5(doc_id::varchar || ':7') < '5' then '' when md5(doc_id::varchar || ':7') < 'a' then '[no text]' else 'page ' || (doc_id % 97)::varchar end as junk from range(1, 201) t(doc_id)")
def y02_empty_examples(s: SparkSession, d: str) -> DataFrame:
    """Seeded examples without content: how many is the feature."""
    return checks.empty_examples(s, 200, 7)


@plan(r"""select file_path, coalesce(nullif(json_extract_string(metadata, '$.title'), ''), 'Unknown') as title, case when text_extract is null then 'metadata' else 'text' end as origin, length(coalesce(text_extract, '')) as chars from pdf_cache""")
def y04_raw_records(s: SparkSession, d: str) -> DataFrame:
    """Raw text, falling back to embedded metadata."""
    got = F.get_json_object("metadata", "$.title")
    return table(s, d, "pdf_cache").select("file_path", F.coalesce(F.when(got != "", got), F.lit("Unknown")).alias("title"), F.when(F.col("text_extract").isNull(), "metadata").otherwise("text").alias("origin"), F.length(F.coalesce("text_extract", F.lit(""))).cast("long").alias("chars"))


@plan(r"""select doc_id, k, d.n as number, case when regexp_matches(d.n, '^(19|20)\d\d$') then 'year' when regexp_matches(d.n, '^\d{1,2}:\d\d$') then 'time' when regexp_matches(d.n, '^\d+\.\d+\.\d+') then 'version' when regexp_matches(d.n, '^\d+\.\d+$') then 'decimal' else 'plain' end as kind
  from (select doc_id, unnest(regexp_extract_all(text, '\d+(?:[.:]\d+)*')) n, generate_subscripts(regexp_extract_all(text, '\d+(?:[.:]\d+)*'), 1) k from documents where text is not null) d""")
def y25_digit_contexts(s: SparkSession, d: str) -> DataFrame:
    """What the digits of a text are: years, times, versions, decimals."""
    n = docs(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\d+(?:[.:]\d+)*"), 0)).alias("k", "number"))
    x = F.col("number")
    kind = F.when(x.rlike(r"^(19|20)\d\d$"), "year").when(x.rlike(r"^\d{1,2}:\d\d$"), "time").when(x.rlike(r"^\d+\.\d+\.\d+"), "version").when(x.rlike(r"^\d+\.\d+$"), "decimal").otherwise("plain")
    return n.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "number", kind.alias("kind"))


QUERIES, SQL = plan.queries, plan.sql
