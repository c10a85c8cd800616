"""Further operators of the inventory: transitions, containment, evaluation, ranking, routing, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import joins
from ..session import cut, table
from .registry import Plans

plan = Plans()


def papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


FORM = r"trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))"


RARE = """w as (select distinct t, unnest(string_split(t, ' ')) w from u), c as (select w, count(*) n from w where w <> '' group by w), k as (select t, w from w join c using (w) qualify row_number() over (partition by t order by n, w) <= 3)"""


@plan(rf"""with p as (select id, file_size, paper_type = 'published' pub, {FORM} t from papers where title is not null), q as (select t, pub, min(id) id, max(file_size) size from p where length(t) > 10 group by all), u as (select distinct t from q), {RARE},
  m as (select distinct x.t a, y.t b from k x join k y using (w)) select a.id published_id, b.id preprint_id, b.size > 1.2 * a.size as preprint_larger from m join q a on a.t = m.a and a.pub join q b on b.t = m.b and not b.pub where levenshtein(a.t, b.t) <= floor(0.1 * greatest(length(a.t), length(b.t)))""")
def j05_preprints(s: SparkSession, d: str) -> DataFrame:
    """Published titles and unpublished ones nearly the same; those meet that have one of their three rarest words in common.

    Pairs meet as numbers: lengths and bits of their titles' letters part nearly all that are too many edits apart, and only for
    the rest the titles are fetched.
    """
    published = F.col("paper_type") == "published"
    k = papers(s, d).where("title is not null").select("id", "file_size", published.alias("pub"), tx.ascii_form("title").alias("t")).where("length(t) > 10")
    one = lambda v, n: (F.min(F.when(v, F.col("id"))).alias(f"{n}_id"), F.max(F.when(v, F.col("file_size"))).alias(f"s{n}"))
    k = cut(k.groupBy("t").agg(F.min("id").alias("key"), *one(F.col("pub"), "a"), *one(~F.col("pub"), "b")))
    words = cut(joins.rare_words(k, "key", "t", joins.word_counts(k, "t")))
    sides = (k.where(F.col(f"{n}_id").isNotNull()).select("key", F.length("t").alias(f"l{n}"), sim.bigram_bits("t").alias("m")).select(F.col("key"), f"l{n}", *(F.element_at("m", i + 1).alias(f"{n}{i}") for i in range(4))) for n in "ab")
    a, b = (x.join(words.hint("merge"), "key").withColumnRenamed("key", f"key_{n}") for x, n in zip(sides, "ab", strict=True))
    room = lambda x, y: F.floor(0.1 * F.greatest(x, y))
    unlike = sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(4))
    most = room(F.col("la"), F.col("lb"))
    met = a.join(b.hint("merge"), "word").where((F.abs(F.col("la") - F.col("lb")) <= most) & (unlike <= 4 * most)).select("key_a", "key_b").distinct()
    side = lambda n: k.select(F.col("key").alias(f"key_{n}"), F.col("t").alias(f"t{n}"), f"{n}_id", f"s{n}").hint("merge")
    near = met.join(side("a"), "key_a").join(side("b"), "key_b")
    near = near.where(F.expr("levenshtein(ta, tb, cast(floor(0.1 * greatest(length(ta), length(tb))) as int)) >= 0"))  # -1 beyond
    return near.select(F.col("a_id").alias("published_id"), F.col("b_id").alias("preprint_id"), (F.col("sb") > 1.2 * F.col("sa")).alias("preprint_larger"))


FAMILIES = "list_distinct(list_transform({}, lambda x: lower(case when contains(x, ',') then trim(split_part(x, ',', 1)) else regexp_extract(trim(x), '(\\S+)$', 1) end)))"


@plan(rf"""with p as (select id, {FORM} t, {FAMILIES.format("from_json(coalesce(nullif(authors, ''), '[]'), '[" + '"VARCHAR"' + "]')")} f from papers where title is not null), r as (select record_id, {FORM} t, {FAMILIES.format("coalesce(authors, [])")} f from metadata_records where title is not null),
  q as (select t, f, min(id) id from p where t <> '' group by t, f), u as (select t from q union select t from r), {RARE}, m as (select distinct x.t a, y.t b from k x join k y using (w)),
  s as (select record_id, q.id, round(0.7 * (1 - levenshtein(r.t, q.t) * 1.0 / greatest(length(r.t), length(q.t))) + 0.3 * case when len(r.f) > 0 and len(q.f) > 0 then len(list_intersect(r.f, q.f)) * 1.0 / least(len(r.f), len(q.f)) else 0 end, 4) score from m join r on r.t = m.a join q on q.t = m.b)
  select record_id, id as paper_id, score from s where score >= 0.75 qualify row_number() over (partition by record_id order by score desc, id) = 1""")
def j11_best_candidate(s: SparkSession, d: str) -> DataFrame:
    """The best paper of each record by title (0.7) and family names of authors (0.3), among those that have one of their three rarest words in common.

    A title alone scores 0.7 at most, so a pair that counts also has a family name in common: pairs meet by word and name.
    """
    families = lambda a: F.array_compact(F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(tx.family(x)))))
    p = papers(s, d).where("title is not null").select("id", tx.ascii_form("title").alias("t"), families(F.from_json("authors", "array<string>")).alias("f")).where("t <> ''").groupBy("t", "f").agg(F.min("id").alias("key"))
    r = table(s, d, "metadata_records").where("title is not null").select("record_id", tx.ascii_form("title").alias("t"), families(F.col("authors")).alias("f"))
    p, r = cut(p), cut(r.withColumn("key", F.monotonically_increasing_id()))
    counts = cut(joins.word_counts(p.select("t").unionByName(r.select("t")).distinct(), "t"))
    named = [x.where(F.size("f") > 0).select("key", F.explode("f").alias("family")).join(joins.rare_words(x.where(F.size("f") > 0), "key", "t", counts).hint("merge"), "key").withColumnRenamed("key", n) for x, n in ((r, "rkey"), (p, "id"))]
    met = named[0].join(named[1].hint("merge"), ["word", "family"]).select("rkey", "id").distinct()
    c = met.join(r.select(F.col("key").alias("rkey"), "record_id", F.col("t").alias("rt"), F.col("f").alias("rf")).hint("merge"), "rkey").join(p.withColumnRenamed("key", "id").hint("merge"), "id")
    both = F.size(F.array_intersect("rf", "f")) / F.least(F.size("rf"), F.size("f"))
    score = F.round(0.7 * (1 - F.levenshtein("rt", "t") / F.greatest(F.length("rt"), F.length("t"))) + 0.3 * both, 4)
    c = c.select("record_id", "id", score.alias("score")).where("score >= 0.75")
    best = c.groupBy("record_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("v"))
    return best.select("record_id", F.col("v.id").alias("paper_id"), "v.score")


@plan("select library_used as method, count(*) as n, round(avg(case when lower(json_extract_string(c.metadata, '$.title')) = lower(p.title) then 1.0 else 0.0 end), 6) as exact from pdf_cache c join papers p using (file_path) group by 1")
def j19_evaluation(s: SparkSession, d: str) -> DataFrame:
    """What extraction methods found against what is known, by path."""
    got = F.lower(F.get_json_object("metadata", "$.title"))
    j = table(s, d, "pdf_cache").join(papers(s, d).select("file_path", "title"), "file_path")
    return j.groupBy(F.col("library_used").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(got == F.lower("title"), 1.0).otherwise(0.0)), 6).alias("exact"))


@plan("select p.id, t.trust_rank from papers p join source_trust t on p.source = t.source")
def j20_reverse_lookup(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", "source").join(table(s, d, "source_trust"), "source").select("id", "trust_rank")


@plan("select file_path, quality_score from pdf_cache where quality_score >= 0.85 order by quality_score desc, file_path limit 20")
def t03_top_confident(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").where("quality_score >= 0.85").select("file_path", "quality_score").orderBy(F.desc("quality_score"), "file_path").limit(20)


@plan(rf"""with u as (select 'papers' origin, id::bigint id, {FORM} k from papers where title is not null union all select 'records', record_id, {FORM} from metadata_records where title is not null) select origin, id, k as form from u where k <> '' qualify row_number() over (partition by k order by origin, id) = 1 order by k limit 500""")
def t04_merged_search(s: SparkSession, d: str) -> DataFrame:
    a = papers(s, d).where("title is not null").select(F.lit("papers").alias("origin"), "id", tx.ascii_form("title").alias("form"))
    u = a.unionByName(table(s, d, "metadata_records").where("title is not null").select(F.lit("records").alias("origin"), F.col("record_id").alias("id"), tx.ascii_form("title").alias("form"))).where("form <> ''")
    one = u.groupBy("form").agg(F.min(F.struct("origin", "id")).alias("v"))
    return one.select("v.origin", "v.id", "form").orderBy("form").limit(500)


@plan("select library_used, file_path, quality_score from pdf_cache where quality_score is not null qualify row_number() over (partition by library_used order by quality_score desc, file_path) <= 5")
def t06_best_by_method(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("library_used").orderBy(F.desc("quality_score"), "file_path")
    return table(s, d, "pdf_cache").where("quality_score is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("library_used", "file_path", "quality_score")


@plan("select list_sort(list(distinct version_type)) as kinds, original_paper_id from versions group by 2")
def t08_sorted_versions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "versions").groupBy("original_paper_id").agg(F.array_sort(F.collect_set("version_type")).alias("kinds"))


@plan("""select p.id, coalesce(nullif(trim(p.journal), ''), r.venue) as venue, greatest(coalesce(r.citation_count, 0), 0) as citations from papers p left join (select title, max(venue) venue, max(citation_count) citation_count from metadata_records where title is not null group by 1) r using (title)""")
def u03_merged_fields(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "metadata_records").where("title is not null").groupBy("title").agg(F.max("venue").alias("venue"), F.max("citation_count").alias("c"))
    j = papers(s, d).join(r, "title", "left")
    return j.select("id", F.coalesce(F.when(F.trim("journal") != "", F.trim("journal")), "venue").alias("venue"), F.greatest(F.coalesce("c", F.lit(0)), F.lit(0)).alias("citations"))


@plan("select source, count(*) as n from (select source from papers where source is not null union all select source from metadata_records) group by 1")
def u04_harvest_counts(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).where("source is not null").select("source").unionByName(table(s, d, "metadata_records").select("source")).groupBy("source").agg(F.count("*").alias("n"))


@plan("select file_path from pdf_cache except select file_path from file_events")
def u06_missing_in_events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").select("file_path").subtract(table(s, d, "file_events").select("file_path"))


@plan("select p.id, len(list_intersect(k, r)) as shared, len(list_distinct(list_concat(k, r))) as either from (select id, string_split(lower(coalesce(title, '')), ' ') k, string_split(lower(coalesce(journal, '')), ' ') r from papers) p")
def u07_token_sets(s: SparkSession, d: str) -> DataFrame:
    k, r = (F.split(F.lower(F.coalesce(c, F.lit(""))), " ") for c in ("title", "journal"))
    return papers(s, d).select("id", F.size(F.array_intersect(k, r)).cast("long").alias("shared"), F.size(F.array_union(k, r)).cast("long").alias("either"))


@plan("select file_path, trim(string_split(text_extract, chr(10))[1]) as top_line, trim(string_split(text_extract, chr(10))[-1]) as last_line from pdf_cache where text_extract <> ''")
def w13_edge_lines(s: SparkSession, d: str) -> DataFrame:
    l = F.split("text_extract", "\n")
    return table(s, d, "pdf_cache").where("text_extract <> ''").select("file_path", F.trim(F.element_at(l, 1)).alias("top_line"), F.trim(F.element_at(l, -1)).alias("last_line"))


@plan("""select event_id, file_path, event_kind from file_events qualify row_number() over (partition by event_id order by arrived_at, file_path) = 1 and row_number() over (partition by event_id order by arrived_at, file_path) is not null""")
def w09_first_delivery(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "file_events").groupBy("event_id").agg(F.min_by(F.struct("file_path", "event_kind"), F.struct("arrived_at", "file_path")).alias("v"))
    return e.select("event_id", "v.file_path", "v.event_kind")


@plan("""select file_path, id from (select id, file_path, (case when title is not null then 1 else 0 end + case when trim(coalesce(doi, '')) <> '' then 1 else 0 end + case when trim(coalesce(journal, '')) <> '' then 1 else 0 end) filled, lower(file_hash) h from papers where trim(coalesce(file_hash, '')) <> '') qualify row_number() over (partition by h order by filled desc, id) = 1""")
def w07_most_complete(s: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0)
    p = papers(s, d).where(F.trim(F.coalesce("file_hash", F.lit(""))) != "").withColumn("filled", F.when(F.col("title").isNotNull(), 1).otherwise(0) + has("doi") + has("journal"))
    return p.groupBy(F.lower("file_hash").alias("h")).agg(F.min_by(F.struct("file_path", "id"), F.struct(-F.col("filled"), "id")).alias("v")).select("v.file_path", "v.id")


@plan("select id, case when doi is not null and trim(doi) <> '' and journal is not null and trim(journal) <> '' then 'published' when trim(coalesce(arxiv_id, '')) <> '' then 'working' else 'unfiled' end || '/' || case when regexp_matches(coalesce(title, ''), '^[A-Za-z]') then upper(left(title, 1)) else 'Z' end as route from papers")
def k09_routes(s: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    status = F.when(has("doi") & has("journal"), "published").when(has("arxiv_id"), "working").otherwise("unfiled")
    return papers(s, d).select("id", F.concat(status, F.lit("/"), F.when(F.coalesce("title", F.lit("")).rlike("^[A-Za-z]"), F.upper(F.left("title", F.lit(1)))).otherwise("Z")).alias("route"))


@plan("select doc_id, case when regexp_matches(left(lower(text), 500), 'abstract|introduction') then 'paper' when regexp_matches(left(lower(text), 1000), 'exercise|problem') then 'teaching' when regexp_matches(left(lower(text), 2000), 'contact|thanks') then 'mail' else 'other' end as kind from documents where text is not null")
def k06_content_type(s: SparkSession, d: str) -> DataFrame:
    head = lambda n: F.left(F.lower("text"), F.lit(n))
    kind = F.when(head(500).rlike("abstract|introduction"), "paper").when(head(1000).rlike("exercise|problem"), "teaching").when(head(2000).rlike("contact|thanks"), "mail").otherwise("other")
    return table(s, d, "documents").where("text is not null").select("doc_id", kind.alias("kind"))


@plan("select event_type, round(0.3 * avg(value) / nullif(max(value), 0) + 0.7 * count(*) / sum(count(*)) over (), 6) as ranking from events group by 1")
def k14_weighted_ranking(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.max("value").alias("x"), F.count("*").alias("n"))
    all_ = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(F.broadcast(all_)).select("event_type", F.round(0.3 * F.try_divide("m", "x") + 0.7 * F.col("n") / F.col("all"), 6).alias("ranking"))  # one row


@plan("select coalesce(id, record_id) as id, source, concat_ws('; ', title, venue) as line from (select id, null::bigint record_id, source, title, journal venue from papers union all select null, record_id, source, title, venue from metadata_records)")
def snk04_flat_rows(s: SparkSession, d: str) -> DataFrame:
    a = papers(s, d).select("id", "source", "title", F.col("journal").alias("venue"))
    u = a.unionByName(table(s, d, "metadata_records").select(F.col("record_id").alias("id"), "source", "title", "venue"))
    return u.select("id", "source", F.concat_ws("; ", "title", "venue").alias("line"))


@plan("select json_extract_string(props, '$.k')::bigint as k, count(*) as n from events group by 1")
def src09_nested_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count("*").alias("n"))


@plan(r"select doi, min(pos) as first_pos from (select doc_id, unnest(regexp_extract_all(text, '\d{4}\.\d{4,5}')) doi, generate_subscripts(regexp_extract_all(text, '\d{4}\.\d{4,5}'), 1) pos from documents) group by 1")
def src16_ids_in_text(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select(F.posexplode(F.regexp_extract_all("text", F.lit(r"\d{4}\.\d{4,5}"), 0)).alias("k", "doi"))
    return x.groupBy("doi").agg((F.min("k") + 1).cast("long").alias("first_pos"))


@plan("select doc_id, {'role': 'user', 'content': left(text, 6000)}::json::varchar is not null as made, least(n_chars, 6000) as kept from documents where n_chars >= 100")
def y03_messages(s: SparkSession, d: str) -> DataFrame:
    msg = F.to_json(F.struct(F.lit("user").alias("role"), F.left("text", F.lit(6000)).alias("content")))
    return table(s, d, "documents").where("n_chars >= 100").select("doc_id", msg.isNotNull().alias("made"), F.least("n_chars", F.lit(6000)).alias("kept"))


@plan("select id, coalesce(nullif(trim(title), ''), split_part(regexp_replace(file_path, '^.*/', ''), ' - ', 2), 'Unknown') as title, coalesce(nullif(authors, '[]'), split_part(regexp_replace(file_path, '^.*/', ''), ' - ', 1)) as authors from papers")
def y10_fallback_fields(s: SparkSession, d: str) -> DataFrame:
    f = tx.sub("file_path", "^.*/")
    part = lambda n: F.split_part(f, F.lit(" - "), F.lit(n))
    return papers(s, d).select("id", F.coalesce(F.when(F.trim("title") != "", F.trim("title")), part(2), F.lit("Unknown")).alias("title"), F.coalesce(F.when(F.col("authors") != "[]", F.col("authors")), part(1)).alias("authors"))


@plan(r"select id, upper(doi) as shout, doi is not null and regexp_matches(doi, '^10\.\d{4,9}/\S+$') as valid, try_cast(volume as integer) as volume from papers")
def y29_validators(s: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.col("doi").rlike(r"^10\.\d{4,9}/\S+$"), F.lit(False))
    return papers(s, d).select("id", F.upper("doi").alias("shout"), ok.alias("valid"), F.col("volume").try_cast("int").alias("volume"))


@plan("select split_part(file_path, '/', 3) as folder, case when split_part(file_path, '/', 3) = 'Published papers' then 'published' when split_part(file_path, '/', 3) in ('Working papers', 'Inbox') then 'working' else 'other' end as status, count(*) as n from papers group by 1")
def y39_locations(s: SparkSession, d: str) -> DataFrame:
    f = F.split_part("file_path", F.lit("/"), F.lit(3))
    g = papers(s, d).groupBy(f.alias("folder")).agg(F.count("*").alias("n"))
    return g.select("folder", F.when(F.col("folder") == "Published papers", "published").when(F.col("folder").isin("Working papers", "Inbox"), "working").otherwise("other").alias("status"), "n")


@plan("select source, struct_pack(n := count(*), chars := sum(n_chars)::bigint).n as n, max(n_chars) as longest from documents group by 1")
def y45_nested_report(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "documents").groupBy("source").agg(F.struct(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).alias("r"), F.max("n_chars").alias("longest"))
    return r.select("source", "r.n", "longest")


@plan("select library_used, round(avg(processing_time), 6) as mean from pdf_cache group by 1 order by mean, library_used limit 1")
def y44_best_library(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").groupBy("library_used").agg(F.round(F.avg("processing_time"), 6).alias("mean")).orderBy("mean", "library_used").limit(1)


QUERIES, SQL = plan.queries, plan.sql
