"""Aggregations, scores and measures (A, K, S, and statistics of W and Y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import search, stats
from ..session import table
from .registry import Plans
from .relational_plans import SRC, source_of

plan = Plans()


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


@plan("select paper_type, count(*) as n, count(distinct lower(file_hash)) as files, count(*) filter (created_at >= '2021-06-01') as recent from papers group by 1")
def a01_statistics(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").groupBy("paper_type").agg(F.count("*").alias("n"), F.count_distinct(F.lower("file_hash")).alias("files"), F.count_if(F.col("created_at") >= "2021-06-01").alias("recent"))


@plan("select lower(file_hash) as hash, count(*) as copies, min(id) as first_id, max(id) as last_id from papers where trim(coalesce(file_hash, '')) <> '' group by 1 having count(*) > 1")
def a02_exact_groups(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").where(F.trim(F.coalesce("file_hash", F.lit(""))) != "")
    return p.groupBy(F.lower("file_hash").alias("hash")).agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("copies > 1")


@plan(r"""select key, count(*) as rows, count(distinct file_path) as paths from (select trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) as key, file_path, arxiv_id from papers where title is not null)
  where key <> '' group by 1 having count(distinct file_path) > 1 and count(distinct nullif(trim(arxiv_id), '')) <= 1""")
def a03_canonical_groups(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").where("title is not null").select(tx.ascii_form("title").alias("key"), "file_path", F.when(F.trim("arxiv_id") != "", F.trim("arxiv_id")).alias("a")).where("key <> ''")
    return p.groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct("file_path").alias("paths"), F.count_distinct("a").alias("k")).where("paths > 1 and k <= 1").drop("k")


@plan(r"""select hash, case when bool_or(paper_type = 'published') and bool_or(paper_type <> 'published') then 'preprint_with_published' when count(distinct split_part(file_path, '/', 3)) > 1 then 'cross_filing' else 'true_duplicate' end as kind
  from (select *, lower(file_hash) hash from papers where trim(coalesce(file_hash, '')) <> '') group by 1 having count(*) > 1""")
def a04_group_kinds(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").where(F.trim(F.coalesce("file_hash", F.lit(""))) != "").withColumn("hash", F.lower("file_hash"))
    pub = F.col("paper_type") == "published"
    folder = F.split_part("file_path", F.lit("/"), F.lit(3))
    g = p.groupBy("hash").agg(F.count("*").alias("n"), F.bool_or(pub).alias("a"), F.bool_or(~pub).alias("b"), F.count_distinct(folder).alias("f")).where("n > 1")
    return g.select("hash", F.when(F.col("a") & F.col("b"), "preprint_with_published").when(F.col("f") > 1, "cross_filing").otherwise("true_duplicate").alias("kind"))


@plan("select source, count(*) as n, min(n_chars) as least, max(n_chars) as most, round(avg(n_chars), 3) as mean, round(quantile_cont(n_chars, 0.5), 3) as median, round(quantile_cont(n_chars, 0.05), 3) as p5, round(quantile_cont(n_chars, 0.95), 3) as p95 from documents group by 1")
def a05_distributions(s: SparkSession, d: str) -> DataFrame:
    return stats.distribution(table(s, d, "documents"), "source", "n_chars")


@plan("select source, list_sort(list(n_chars))[count(*) // 2 + 1] as upper_median from documents where source is not null group by 1")
def a06_upper_median(s: SparkSession, d: str) -> DataFrame:
    return stats.upper_median(table(s, d, "documents").where("source is not null"), "source", "n_chars")


@plan("with r as (select min(n_chars) lo, max(n_chars) hi from documents) select cast(least(floor((n_chars - lo) / ((hi - lo) / 20.0)), 19) as bigint) as bin, count(*) as n from documents, r group by 1")
def a07_histogram(s: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(s, d, "documents"), "n_chars", 20)


@plan(f"select s as source, count(*) as n, round(avg(case when confidence > 1 then confidence / 100 else confidence end), 6) as mean_confidence, count(*) filter (title is null) as no_title from (select *, {SRC} s from papers where confidence is not null and not isnan(confidence)) group by 1")
def a08_summary_by_source(s: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return table(s, d, "papers").where("confidence is not null and not isnan(confidence)").groupBy(source_of().alias("source")).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean_confidence"), F.count_if(F.col("title").isNull()).alias("no_title"))


@plan("select lang, count(*) as n, rank() over (order by count(*) desc) as rank from documents group by 1")
def a09_most_common(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return g.select("lang", "n", F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("rank"))


@plan(r"select source, count(*) filter (n_chars < 200) as short, round(avg(length(regexp_replace(text, '[\x00-\x7f]', '', 'g')) * 1.0 / greatest(n_chars, 1)), 6) as other_script, round(quantile_cont(n_chars, 0.25), 2) as p25 from documents where text is not null group by 1")
def a10_content_quality(s: SparkSession, d: str) -> DataFrame:
    other = F.length(tx.sub("text", r"[\x00-\x7f]")) / F.greatest("n_chars", F.lit(1))
    return docs(s, d).groupBy("source").agg(F.count_if(F.col("n_chars") < 200).alias("short"), F.round(F.avg(other), 6).alias("other_script"), F.round(F.percentile("n_chars", F.lit(0.25)), 2).alias("p25"))


@plan("select source, sum(ceil(n_chars / 4.0))::bigint as tokens, count(*) filter (ceil(n_chars / 4.0) + 50 > 300) as cut from documents group by 1")
def a11_token_audit(s: SparkSession, d: str) -> DataFrame:
    t = F.ceil(F.col("n_chars") / 4.0)
    return table(s, d, "documents").groupBy("source").agg(F.sum(t).cast("long").alias("tokens"), F.count_if(t + 50 > 300).alias("cut"))


@plan("select library_used, round(avg(processing_time), 6) as mean_time, round(avg(quality_score), 6) as quality, round(greatest(0, 1 - 2 * var_pop(quality_score)), 6) as consistency, round(least(greatest(1 - (avg(processing_time) - 1) / 9, 0), 1), 6) as speed from pdf_cache group by 1")
def a12_source_ranking(s: SparkSession, d: str) -> DataFrame:
    m = F.avg("processing_time")
    return table(s, d, "pdf_cache").groupBy("library_used").agg(F.round(m, 6).alias("mean_time"), F.round(F.avg("quality_score"), 6).alias("quality"), F.round(F.greatest(F.lit(0.0), 1 - 2 * F.var_pop("quality_score")), 6).alias("consistency"), F.round(F.least(F.greatest(1 - (m - 1) / 9, F.lit(0.0)), F.lit(1.0)), 6).alias("speed"))


@plan("select source, lang, count(*) as n, sum(n_chars)::bigint as chars, min(n_chars) as least, max(n_chars) as most from documents group by grouping sets ((source, lang), (lang))")
def a13_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents")
    return t.groupingSets([[F.col("source"), F.col("lang")], [F.col("lang")]], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


TOPICS = [("analysis", "operator"), ("analysis", "measure"), ("probability", "stochastic"), ("probability", "martingale"), ("geometry", "manifold"), ("geometry", "curvature"), ("algebra", "ring"), ("algebra", "module")]


@plan("with k(topic, word) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in TOPICS) + "), h as (select id, topic, sum((length(t) - length(replace(t, word, ''))) / length(word)) as score from (select id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) t from papers), k group by all) select id, topic, score::bigint as score from h where score >= 2 qualify row_number() over (partition by id order by score desc, topic) = 1")
def a15_topics(s: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    p = table(s, d, "papers").select("id", t.alias("t"))
    scores = {k: sum(F.floor((F.length("t") - F.length(F.replace("t", F.lit(w), F.lit("")))) / len(w)) for a, w in TOPICS if a == k) for k in dict(TOPICS)}
    best = F.array_max(F.array(*(F.struct(n.cast("long").alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("topic")) for i, (k, n) in enumerate(sorted(scores.items())))))
    return p.select("id", best.alias("b")).where("b.score >= 2").select("id", "b.topic", "b.score")


@plan("select event_type, round(avg(value), 6) as mean, max(value) as most from events group by 1 having avg(value) > 10")
def a16_slow_kinds(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).where("mean > 10")


@plan("select k as event_kind, count(e.event_id) as n from (values ('created'), ('modified'), ('moved'), ('deleted'), ('failed')) v(k) left join file_events e on e.event_kind = k group by 1")
def a17_zero_filled(s: SparkSession, d: str) -> DataFrame:
    kinds = s.createDataFrame([(k,) for k in ("created", "modified", "moved", "deleted", "failed")], "event_kind string")
    n = table(s, d, "file_events").groupBy("event_kind").agg(F.count("*").alias("n"))
    return kinds.join(n, "event_kind", "left").select("event_kind", F.coalesce("n", F.lit(0)).alias("n"))


@plan("select l_returnflag, v as weighted_mode from (select l_returnflag, round(l_quantity / 5) * 5 v, sum(l_extendedprice) w from lineitem group by all) qualify row_number() over (partition by l_returnflag order by round(w, 2) desc, v) = 1")
def a18_weighted_mode(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").groupBy("l_returnflag", (F.round(F.col("l_quantity") / 5) * 5).alias("v")).agg(F.sum("l_extendedprice").alias("w"))
    return g.groupBy("l_returnflag").agg(F.max_by("v", F.struct(F.round("w", 2), -F.col("v"))).alias("weighted_mode"))


@plan("select library_used, round(count(quality_score) * 1.0 / count(*), 6) as rated, round(sum(access_count) * 1.0 / nullif(sum(file_size), 0), 9) as per_byte from pdf_cache group by 1")
def a19_rates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").groupBy("library_used").agg(F.round(F.try_divide(F.count("quality_score"), F.count("*")), 6).alias("rated"), F.round(F.try_divide(F.sum("access_count"), F.sum("file_size")), 9).alias("per_byte"))


FIELDS = ["title", "authors", "doi", "journal", "volume", "pages", "abstract", "arxiv_id"]


@plan(" union all ".join(f"select '{f}' as field, count({f}) as filled, count(distinct {f}) as kinds from papers" for f in FIELDS))
def a20_completeness(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "papers").select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in FIELDS))).alias("x")).select("x.*")
    return one.groupBy("field").agg(F.count("v").alias("filled"), F.count_distinct("v").alias("kinds"))


@plan("select lang, count(*) filter (n_chars < 300) as short, count(*) filter (n_chars between 300 and 1200) as medium, count(*) filter (n_chars > 1200) as long from documents group by 1")
def a21_pivot(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").withColumn("size", F.when(F.col("n_chars") < 300, "short").when(F.col("n_chars") <= 1200, "medium").otherwise("long"))
    return t.groupBy("lang").pivot("size", ["short", "medium", "long"]).agg(F.count(F.lit(1))).fillna(0)


@plan("select sum(total - first_size)::bigint as wasted from (select lower(file_hash), sum(file_size) total, arg_min(file_size, id) first_size from papers where trim(coalesce(file_hash, '')) <> '' group by 1 having count(*) > 1)")
def a22_wasted_space(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "papers").where(F.trim(F.coalesce("file_hash", F.lit(""))) != "").groupBy(F.lower("file_hash").alias("h")).agg(F.count("*").alias("n"), F.sum("file_size").alias("t"), F.min_by("file_size", "id").alias("f"))
    return g.where("n > 1").agg(F.sum(F.col("t") - F.col("f")).alias("wasted"))


@plan("""select family, count(distinct name) as names from (select name, case when contains(name, ',') then trim(split_part(name, ',', 1)) else regexp_extract(trim(name), '(\\S+)$', 1) end family from (select unnest(from_json(authors, '["VARCHAR"]')) as name from papers)) group by 1 having count(distinct name) > 5""")
def a23_ambiguous_families(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "papers").select(F.explode(tx.author_list("authors")).alias("name")).distinct()
    return n.groupBy(tx.family(F.col("name")).alias("family")).agg(F.count("*").alias("names")).where("names > 5")


@plan(r"select try_cast(nullif(regexp_extract(publication_date, '(1[89]\d\d|20\d\d)', 1), '') as integer) as year, count(*) as n from papers group by 1")
def a24_by_year(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").groupBy(tx.year("publication_date").alias("year")).agg(F.count("*").alias("n"))


@plan("select id, cast(" + " + ".join(f"(case when trim(coalesce({f}, '')) <> '' then 1 else 0 end)" for f in FIELDS) + " as integer) as filled from papers")
def a25_completeness_score(s: SparkSession, d: str) -> DataFrame:
    score = sum(F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) != "", 1).otherwise(0) for f in FIELDS)
    return table(s, d, "papers").select("id", score.alias("filled"))


@plan(f"select lower(trim(doi)) as doi, arg_min(title, coalesce(t.trust_rank, 99) * 1000000 + id) as title from (select *, {SRC} s from papers where trim(coalesce(doi, '')) <> '' and title is not null) p left join source_trust t on t.source = p.s group by 1")
def a27_by_priority(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").where((F.trim(F.coalesce("doi", F.lit(""))) != "") & F.col("title").isNotNull()).withColumn("source", source_of()).join(table(s, d, "source_trust"), "source", "left")
    return p.groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.min_by("title", F.struct(F.coalesce("trust_rank", F.lit(99)), "id")).alias("title"))


@plan("""with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) rn, count(*) over (partition by user_id) n from events)
  select user_id, round(sum(value * case when rn = 1 then power(0.7, n - 1) else 0.3 * power(0.7, n - rn) end), 6) as ema from e group by 1""")
def w05_moving_average(s: SparkSession, d: str) -> DataFrame:
    return stats.exponential_average(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", 0.3)


@plan("with t as (select doc_id, text from documents where text is not null) select doc_id, round(ln(1 + length(text)) / ln(10), 6) as size_score, length(text) - length(replace(text, '.', '')) as stops, least(1.0, round(length(text) / 1000.0, 6)) as length_score from t")
def k02_text_quality(s: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return docs(s, d).select("doc_id", F.round(F.log10(1 + n), 6).alias("size_score"), (n - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("stops"), F.least(F.lit(1.0), F.round(n / 1000.0, 6)).alias("length_score"))


@plan("""select id, round(0.4 * (case when length(coalesce(title, '')) > 10 then 1 else 0 end) + 0.3 * (case when coalesce(authors, '[]') <> '[]' then 1 else 0 end) + 0.2 * (case when length(coalesce(abstract, '')) > 100 then 1 else 0 end) + 0.1 * (case when trim(coalesce(doi, '')) <> '' then 1 else 0 end), 4)::double as score from papers""")
def k01_metadata_score(s: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    e = lambda c, v="": F.coalesce(F.col(c), F.lit(v))
    score = 0.4 * one(F.length(e("title")) > 10) + 0.3 * one(e("authors", "[]") != "[]") + 0.2 * one(F.length(e("abstract")) > 100) + 0.1 * one(F.trim(e("doi")) != "")
    return table(s, d, "papers").select("id", F.round(score, 4).alias("score"))


@plan(r"select id, round(0.4 + least(len(regexp_extract_all(coalesce(abstract, ''), '\S+')) / 200.0, 0.3) + least(0.05 * len(from_json(coalesce(research_areas, '[]'), '[" + '"VARCHAR"' + r"]')), 0.2), 4) as score from papers")
def k04_relevance(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count(F.coalesce("abstract", F.lit("")), F.lit(r"\S+"))
    areas = F.size(F.from_json(F.coalesce("research_areas", F.lit("[]")), "array<string>"))
    return table(s, d, "papers").select("id", F.round(0.4 + F.least(n / 200.0, F.lit(0.3)) + F.least(0.05 * areas, F.lit(0.2)), 4).alias("score"))


LANGS = {"en": [" the ", " and ", " of "], "de": [" der ", " und ", " die "], "fr": [" le ", " les ", " des "]}


@plan("with t as (select doc_id, " + ", ".join("(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) / {len(w)}" for w in ws) + f") as {k}" for k, ws in LANGS.items()) + " from (select doc_id, ' ' || lower(text) || ' ' t from documents where text is not null)) select doc_id, case when greatest(en, de, fr) < 3 then 'en' when en >= de and en >= fr then 'en' when de >= fr then 'de' else 'fr' end as language from t")
def k07_language(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).select("doc_id", F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("t"))
    n = {k: sum((F.length("t") - F.length(F.replace("t", F.lit(w), F.lit("")))) / len(w) for w in ws) for k, ws in LANGS.items()}
    t = t.select("doc_id", *(v.alias(k) for k, v in n.items()))
    return t.select("doc_id", F.when(F.greatest("en", "de", "fr") < 3, "en").when((F.col("en") >= F.col("de")) & (F.col("en") >= F.col("fr")), "en").when(F.col("de") >= F.col("fr"), "de").otherwise("fr").alias("language"))


@plan("""select a.id, round(1 - levenshtein(a.t, b.t) * 1.0 / greatest(length(a.t), length(b.t)), 6) as edit, round(2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)), 6) as f1, round(len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))), 6) as jaccard
  from (select id, original_paper_id o, updated_paper_id u from versions) v join t a on a.id = v.o join t b on b.id = v.u""".replace("select a.id,", "with t as (select id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) t, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')), ' ')) w from papers where title is not null) select v.id,", 1) + " where a.t <> '' and b.t <> ''")
def s06_title_measures(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "papers").where("title is not null").select("id", tx.ascii_form("title").alias("t")).where("t <> ''").withColumn("w", F.array_distinct(F.split("t", " ")))
    v = table(s, d, "versions").select(F.col("id").alias("v"), "original_paper_id", "updated_paper_id")
    a, b = (t.select(F.col("id").alias(k), F.col("t").alias(f"t{x}"), F.col("w").alias(f"w{x}")) for k, x in (("original_paper_id", "a"), ("updated_paper_id", "b")))
    j = v.join(a, "original_paper_id").join(b, "updated_paper_id")
    x, y = F.col("wa"), F.col("wb")
    return j.select(F.col("v").alias("id"), F.round(sim.edit_ratio(F.col("ta"), F.col("tb")), 6).alias("edit"), F.round(sim.token_f1(x, y), 6).alias("f1"), F.round(sim.jaccard(x, y), 6).alias("jaccard"))


@plan(None)
def s01_indel_ratio(s: SparkSession, d: str) -> DataFrame:
    """Longest-common-subsequence likeness, best-stretch likeness and block likeness of version titles."""
    t = table(s, d, "papers").select("id", F.lower(F.coalesce("title", F.lit(""))).alias("t"))
    v = table(s, d, "versions").select(F.col("id").alias("v"), "original_paper_id", "updated_paper_id")
    j = v.join(t.toDF("original_paper_id", "ta"), "original_paper_id").join(t.toDF("updated_paper_id", "tb"), "updated_paper_id")
    return j.select(F.col("v").alias("id"), F.round(sim.indel_ratio("ta", "tb"), 6).alias("indel"), F.round(sim.partial_ratio("ta", "tb"), 6).alias("partial"), F.round(sim.block_ratio("ta", "tb"), 6).alias("blocks"))


@plan(None)
def s11_cosine_to_mean(s: SparkSession, d: str) -> DataFrame:
    """Likeness of each vector to the mean of its label."""
    return stats.cosine_to_mean(table(s, d, "embeddings"), "vec_id", "label", "embedding")


BM25_QUERY = ["stochastic", "martingales", "plane"]


@plan(r"""with t as (select id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{L}\p{N}_]+') w from papers), n as (select count(*) total, avg(len(w)) mean from t),
  p as (select id, len(w) size, unnest(w) term from t), f as (select id, size, term, count(*) tf from p where term in ('stochastic', 'martingales', 'plane') group by all), df as (select term, count(*) df from f group by 1)
  select id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) as score from f join df using (term), n group by id order by score desc, id limit 50""")
def j01_text_search(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return search.bm25(table(s, d, "papers").select("id", text.alias("text")), "id", "text", BM25_QUERY, 50)


@plan("select a.user_id, a.event_id from (select *, lag(ts) over (partition by user_id order by ts, event_id) before from events) a where ts - before < interval 60 second")
def st07_too_fast(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp")) < 60_000_000).select("user_id", "event_id")


@plan("select flag, count(*) as n from (select unnest(list_filter([case when length(coalesce(title, '')) < 15 then 'short_title' end, case when length(title) > 200 then 'long_title' end, case when contains(title, chr(65533)) then 'lost_character' end, case when length(coalesce(abstract, '')) < 500 then 'short_text' end], lambda x: x is not null)) as flag from papers) group by 1")
def y01_anomalies(s: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    flags = F.array_compact(F.array(F.when(e("title") < 15, "short_title"), F.when(F.length("title") > 200, "long_title"), F.when(F.contains("title", F.lit("�")), "lost_character"), F.when(e("abstract") < 500, "short_text")))
    return table(s, d, "papers").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@plan("select count(*) filter (trim(coalesce(title, '')) = '') as no_title, count(*) filter (confidence is null or isnan(confidence)) as no_confidence, count(*) filter (file_size = 0) as empty_files, count(*) as rows from papers")
def y06_contract(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").agg(F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("no_title"), F.count_if(F.col("confidence").isNull() | F.isnan("confidence")).alias("no_confidence"), F.count_if(F.col("file_size") == 0).alias("empty_files"), F.count("*").alias("rows"))


QUERIES, SQL = plan.queries, plan.sql
