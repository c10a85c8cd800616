"""Scores, classes and smaller text operators (K, N, S, E, X and Y of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filenames as fn
from ..functions import similarity as sim
from ..functions import text as tx
from ..session import table
from .registry import Plans

plan = Plans()


def papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


def empty(c: str):
    return F.coalesce(F.col(c), F.lit(""))


@plan(r"""select doc_id, len(regexp_extract_all(text, '\p{L}+')) as words, len(regexp_extract_all(text, '\d+')) as numbers, len(regexp_extract_all(text, '\$[^$]*\$')) as formulas, len(regexp_extract_all(text, '[.!?]')) as stops from documents where text is not null""")
def a14_token_counts(s: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return docs(s, d).select("doc_id", n(r"\p{L}+").alias("words"), n(r"\d+").alias("numbers"), n(r"\$[^$]*\$").alias("formulas"), n("[.!?]").alias("stops"))


@plan("select count(*) filter (text_extract <> '') as succeeded, count(*) filter (coalesce(text_extract, '') = '') as failed, count(*) filter (access_count > 1) as reused, count(*) as files from pdf_cache")
def a26_outcomes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").agg(F.count_if(F.col("text_extract") != "").alias("succeeded"), F.count_if(empty("text_extract") == "").alias("failed"), F.count_if(F.col("access_count") > 1).alias("reused"), F.count("*").alias("files"))


@plan(r"select id, trim(regexp_replace(regexp_replace(regexp_replace(title, '^\s*(title|abstract)\s*:\s*', '', 'i'), '\s*\[preprint\]\s*$|\s*\(extended version\)\s*$', ''), '\s+', ' ', 'g')) as form from papers")
def c05_clean_title(s: SparkSession, d: str) -> DataFrame:
    t = tx.sub(tx.sub("title", r"(?i)^\s*(title|abstract)\s*:\s*"), r"\s*\[preprint\]\s*$|\s*\(extended version\)\s*$")
    return papers(s, d).select("id", tx.spaces(t).alias("form"))


@plan(r"select file_path, nullif(regexp_extract(file_path, '(10\.\d{4,9}[_/][A-Za-z0-9.]+)', 1), '') as doi, nullif(regexp_extract(file_path, 'Unknown (\d+)', 1), '') as number from pdf_cache")
def e05_ids_in_names(s: SparkSession, d: str) -> DataFrame:
    x = lambda p: F.when(F.regexp_extract("file_path", p, 1) != "", F.regexp_extract("file_path", p, 1))
    return table(s, d, "pdf_cache").select("file_path", x(r"(10\.\d{4,9}[_/][A-Za-z0-9.]+)").alias("doi"), x(r"Unknown (\d+)").alias("number"))


@plan("select id, case when title is null or length(title) < 10 or upper(title) = title or contains(lower(title), 'unknown') then 'bad' else 'good' end as looks from papers")
def e11_looks_bad(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return papers(s, d).select("id", F.when(t.isNull() | (F.length(t) < 10) | (F.upper(t) == t) | F.contains(F.lower(t), F.lit("unknown")), "bad").otherwise("good").alias("looks"))


@plan("select record_id, round(0.3 * (case when title is not null then 1 else 0 end) + 0.3 * (case when len(authors) > 0 then 1 else 0 end) + 0.2 * (case when venue is not null then 1 else 0 end) + 0.2 * least(coalesce(citation_count, 0) / 50.0, 1), 6) as score from metadata_records")
def k03_provider_score(s: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = 0.3 * one(F.col("title").isNotNull()) + 0.3 * one(F.coalesce(F.size("authors") > 0, F.lit(False))) + 0.2 * one(F.col("venue").isNotNull()) + 0.2 * F.least(F.coalesce("citation_count", F.lit(0)) / 50.0, F.lit(1.0))
    return table(s, d, "metadata_records").select("record_id", F.round(score, 6).alias("score"))


SUBJECTS = {"dynamics": (["ergodic", "flow"], ["mixing", "recurrence"]), "geometry": (["manifold", "foliation"], ["curvature", "sheaf"]), "probability": (["stochastic", "martingale"], ["noise", "diffusion"])}


@plan("with t as (select doc_id, lower(text) t from documents where text is not null), k as (select doc_id, " + ", ".join("(" + " + ".join([f"3 * (case when contains(t, '{w}') then 1 else 0 end)" for w in a] + [f"(case when contains(t, '{w}') then 1 else 0 end)" for w in b]) + f") as {k}" for k, (a, b) in SUBJECTS.items()) + " from t) select doc_id, case when greatest(dynamics, geometry, probability) < 3 then null when dynamics >= geometry and dynamics >= probability then 'dynamics' when geometry >= probability then 'geometry' else 'probability' end as subject from k")
def k05_subject(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).select("doc_id", F.lower("text").alias("t"))
    one = lambda w: F.when(F.contains("t", F.lit(w)), 1).otherwise(0)
    t = t.select("doc_id", *((3 * sum(map(one, a)) + sum(map(one, b))).alias(k) for k, (a, b) in SUBJECTS.items()))
    g, p, y = F.col("geometry"), F.col("probability"), F.col("dynamics")
    return t.select("doc_id", F.when(F.greatest(y, g, p) < 3, None).when((y >= g) & (y >= p), "dynamics").when(g >= p, "geometry").otherwise("probability").alias("subject"))


@plan("select distinct journal, case when contains(lower(journal), 'annals') then 1 when contains(lower(journal), 'journal') or contains(lower(journal), 'transactions') then 2 else 3 end as tier from papers where trim(coalesce(journal, '')) <> ''")
def k08_journal_tier(s: SparkSession, d: str) -> DataFrame:
    j = F.lower("journal")
    tier = F.when(F.contains(j, F.lit("annals")), 1).when(F.contains(j, F.lit("journal")) | F.contains(j, F.lit("transactions")), 2).otherwise(3)
    return papers(s, d).where(F.trim(empty("journal")) != "").select("journal", tier.alias("tier")).distinct()


@plan(r"select id, case when regexp_matches(coalesce(doi, ''), '10\.\d+/') then 'journal' when regexp_matches(coalesce(arxiv_id, ''), '\d{4}\.') then 'archive' when contains(file_path, 'Theses') then 'thesis' else 'other' end as repository from papers")
def k10_repository(s: SparkSession, d: str) -> DataFrame:
    r = F.when(empty("doi").rlike(r"10\.\d+/"), "journal").when(empty("arxiv_id").rlike(r"\d{4}\."), "archive").when(F.contains("file_path", F.lit("Theses")), "thesis").otherwise("other")
    return papers(s, d).select("id", r.alias("repository"))


@plan("select id, round(least(1, greatest(0, case when confidence is null or isnan(confidence) then 0.5 when confidence > 1 then confidence / 100 else confidence end + case when trim(coalesce(doi, '')) <> '' then 0.1 else -0.05 end)), 6) as calibrated from papers")
def k11_calibrated(s: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.5).when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return papers(s, d).select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x + F.when(F.trim(empty("doi")) != "", 0.1).otherwise(-0.05))), 6).alias("calibrated"))


@plan("with s as (select library_used, count(*) n, avg(quality_score) m, stddev_pop(quality_score) d from pdf_cache where quality_score is not null group by 1), g as (select avg(quality_score) m from pdf_cache where quality_score is not null) select c.file_path, round(abs(c.quality_score - case when s.n >= 3 then s.m else g.m end), 6) as off from pdf_cache c join s using (library_used), g where c.quality_score is not null")
def k12_against_learned(s: SparkSession, d: str) -> DataFrame:
    """Distance of a value from its group's mean, from the whole's where a group has fewer than three."""
    c = table(s, d, "pdf_cache").where("quality_score is not null").select("file_path", "library_used", "quality_score")
    own = c.groupBy("library_used").agg(F.count("*").alias("n"), F.avg("quality_score").alias("m"))
    whole = c.agg(F.avg("quality_score").alias("g"))
    j = c.join(own, "library_used").crossJoin(F.broadcast(whole))  # one row
    return j.select("file_path", F.round(F.abs(F.col("quality_score") - F.when(F.col("n") >= 3, F.col("m")).otherwise(F.col("g"))), 6).alias("off"))


@plan(r"select doc_id, round(0.5 * least(len(regexp_extract_all(text, '\$[^$]+\$')) / 5.0, 1) + 0.3 * least(len(regexp_extract_all(lower(text), 'theorem|lemma|proposition|proof')) / 5.0, 1) + 0.2 * (case when n_chars > 400 then 1 else 0 end), 6) as score from documents where text is not null")
def k13_academic_score(s: SparkSession, d: str) -> DataFrame:
    n = lambda c, p: F.least(F.regexp_count(c, F.lit(p)) / 5.0, F.lit(1.0))
    score = 0.5 * n("text", r"\$[^$]+\$") + 0.3 * n(F.lower("text"), "theorem|lemma|proposition|proof") + 0.2 * F.when(F.col("n_chars") > 400, 1.0).otherwise(0.0)
    return docs(s, d).select("doc_id", F.round(score, 6).alias("score"))


@plan(r"""select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\s*(,?\s*(part|no\.?|volume)\s+\d+|\s+(ii|iii|iv|v|vi))\s*$', ''), '^(the|a|an|on)\s+', ''), '[:;,]', '', 'g')) as form from papers""")
def n02_series_free(s: SparkSession, d: str) -> DataFrame:
    t = tx.sub(F.lower("title"), r"\s*(,?\s*(part|no\.?|volume)\s+\d+|\s+(ii|iii|iv|v|vi))\s*$")
    return papers(s, d).select("id", F.trim(tx.sub(tx.sub(t, r"^(the|a|an|on)\s+"), "[:;,]")).alias("form"))


@plan(r"""select id, string_agg(f, ',' order by f) as form from (select distinct id, lower(case when contains(n, ',') then trim(split_part(n, ',', 1)) else regexp_extract(trim(n), '(\S+)$', 1) end) f from (select id, unnest(from_json(authors, '["VARCHAR"]')) n from papers)) group by id""")
def n03_author_key(s: SparkSession, d: str) -> DataFrame:
    f = papers(s, d).select("id", F.explode(tx.author_list("authors")).alias("n")).select("id", F.lower(tx.family(F.col("n"))).alias("f"))
    return f.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("form"))


@plan(r"select id, trim(regexp_replace(translate(lower(title), 'äöüéèêáàóøçñğč', 'aoueeeaaoocngc'), '\s+', ' ', 'g')) as form from papers")
def n04_transliterated(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.spaces(F.translate(F.lower("title"), "äöüéèêáàóøçñğč", "aoueeeaaoocngc")).alias("form"))


@plan(r"select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(title, '\$[^$]*\$', ' ', 'g'), '\\[A-Za-z]+\{([^{}]*)\}', '\1', 'g'), '\\[A-Za-z]+', ' ', 'g')), '[{}]', '', 'g'), '[‐‑‒–—―−]', '-', 'g'), '[‘’‚‛“”„‟]', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as form from papers")
def n14_title_form(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.title_form("title").alias("form"))


@plan("with w as (select distinct source w from documents where source is not null) select w as phrase, unnest([w, replace(w, '_', ' '), replace(w, '_', '-')]) as variant from w where contains(w, '_')")
def n15_variants(s: SparkSession, d: str) -> DataFrame:
    w = docs(s, d).where("source is not null").select(F.col("source").alias("phrase")).distinct().where(F.contains("phrase", F.lit("_")))
    swap = lambda x: F.replace("phrase", F.lit("_"), F.lit(x))
    return w.select("phrase", F.explode(F.array(F.col("phrase"), swap(" "), swap("-"))).alias("variant"))


AB = r"""with a as (select id, list_distinct(list_transform(from_json(authors, '["VARCHAR"]'), lambda n: lower(case when contains(n, ',') then trim(split_part(n, ',', 1)) else regexp_extract(trim(n), '(\S+)$', 1) end))) f from papers)"""


@plan(AB + """ select v.id, case when len(a.f) = 0 or len(b.f) = 0 then 0.5 else round(len(list_intersect(a.f, b.f)) * 1.0 / len(list_distinct(list_concat(a.f, b.f))), 6) end as overlap, len(a.f) > 0 and len(b.f) > 0 and len(list_intersect(a.f, b.f)) * 1.0 / greatest(len(a.f), len(b.f), 1) >= 0.6 as matches
  from versions v join a on a.id = v.original_paper_id join a b on b.id = v.updated_paper_id""")
def s08_author_overlap(s: SparkSession, d: str) -> DataFrame:
    a = papers(s, d).select("id", F.array_distinct(F.transform(tx.author_list("authors"), lambda n: F.lower(tx.family(n)))).alias("f")).where("f is not null")
    v = table(s, d, "versions").select(F.col("id").alias("v"), "original_paper_id", "updated_paper_id")
    j = v.join(a.toDF("original_paper_id", "x"), "original_paper_id").join(a.toDF("updated_paper_id", "y"), "updated_paper_id")
    x, y = F.col("x"), F.col("y")
    return j.select(F.col("v").alias("id"), F.round(sim.jaccard(x, y, 0.5, 0.5), 6).alias("overlap"), (sim.overlap_of_larger(x, y) >= 0.6).alias("matches"))


@plan("select library_used, round(case when avg(quality_score) + avg(access_count) = 0 then 0 else 2 * avg(quality_score) * avg(access_count) / (avg(quality_score) + avg(access_count)) end, 6) as combined from pdf_cache group by 1")
def s10_combined(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").groupBy("library_used").agg(F.round(sim.harmonic(F.avg("quality_score"), F.avg("access_count")), 6).alias("combined"))


@plan("select source, round(avg(confidence), 6) as mean from papers where confidence between 0 and 1 and not isnan(confidence) and source is not null group by 1 having avg(confidence) >= 0.7 order by mean desc, source limit 5")
def t05_recommended(s: SparkSession, d: str) -> DataFrame:
    g = papers(s, d).where("confidence between 0 and 1 and not isnan(confidence) and source is not null").groupBy("source").agg(F.avg("confidence").alias("m"))
    return g.where("m >= 0.7").select("source", F.round("m", 6).alias("mean")).orderBy(F.desc("mean"), "source").limit(5)


@plan("""select h as hash, arg_max(title, score * 1000000 - id) as title from (select lower(file_hash) h, title, id, case when length(title) between 15 and 200 then 2 else 0 end + case when title <> upper(title) then 1 else 0 end as score from papers where trim(coalesce(file_hash, '')) <> '' and title is not null) group by 1""")
def t07_best_title(s: SparkSession, d: str) -> DataFrame:
    score = F.when(F.length("title").between(15, 200), 2).otherwise(0) + F.when(F.col("title") != F.upper("title"), 1).otherwise(0)
    p = papers(s, d).where((F.trim(empty("file_hash")) != "") & F.col("title").isNotNull())
    return p.groupBy(F.lower("file_hash").alias("hash")).agg(F.max_by("title", F.struct(score, -F.col("id"))).alias("title"))


@plan(r"select id, len(regexp_extract_all(title, '\$[^$]*\$|\\[A-Za-z]+')) > 0 as has_math from papers where title is not null")
def x04_contains_math(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).where("title is not null").select("id", F.col("title").rlike(r"\$[^$]*\$|\\[A-Za-z]+").alias("has_math"))


@plan("""select name, trim(split_part(name, ',', 2)) as given, trim(split_part(name, ',', 1)) as family from (select distinct unnest(from_json(authors, '["VARCHAR"]')) as name from papers) where contains(name, ',')""")
def x09_author_parts(s: SparkSession, d: str) -> DataFrame:
    n = papers(s, d).select(F.explode(tx.author_list("authors")).alias("name")).distinct().where(F.contains("name", F.lit(",")))
    part = lambda k: F.trim(F.split_part("name", F.lit(","), F.lit(k)))
    return n.select("name", part(2).alias("given"), part(1).alias("family"))


@plan(None)
def n20_accent_macros(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).where("title is not null").select("id", fn.accents("title").alias("form"))


@plan("select doc_id, case when contains(text, '  ') then 'double space' end as double_space, case when contains(text, ' ,') then 'space before comma' end as comma, len(string_split(text, chr(10))) as lines from documents where text is not null")
def y22_spacing(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.when(F.contains("text", F.lit("  ")), "double space").alias("double_space"), F.when(F.contains("text", F.lit(" ,")), "space before comma").alias("comma"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@plan(r"with c as (select unnest(regexp_extract_all(lower(title), '\p{L}+-\p{L}+')) c from papers), k as (select c, count(*) n from c group by 1) select c as compound, n from k where replace(c, '-', '') not in (select unnest(regexp_extract_all(lower(title), '\p{L}+')) from papers where title is not null)")
def y23_unknown_compounds(s: SparkSession, d: str) -> DataFrame:
    p = papers(s, d).where("title is not null")
    c = p.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}+-\p{L}+"), 0)).alias("compound")).groupBy("compound").agg(F.count("*").alias("n"))
    w = p.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}+"), 0)).alias("w")).distinct()
    return c.join(w, F.replace("compound", F.lit("-"), F.lit("")) == F.col("w"), "left_anti").select("compound", "n")


@plan("select coalesce(lang, 'none') as lang, len(list_distinct(list(source) filter (source is not null))) as sources, count(*) as n from documents group by 1")
def y40_categories(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n"))


QUERIES, SQL = plan.queries, plan.sql
