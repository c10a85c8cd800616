"""Scans, filters, joins, sets and order (SRC, FLT, J, U, T, W of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import joins
from ..session import table
from .registry import Plans

plan = Plans()
DAY = "2026-01-01"  # "now" is a parameter everywhere
SRC = "nullif(replace(replace(lower(trim(source)), ' ', '_'), '-', '_'), '')"


def source_of(c: str = "source"):
    s = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    return F.when(s != "", s)


@plan("select file_path, file_size from pdf_cache order by file_path limit 25")
def src03_first_files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").select("file_path", "file_size").orderBy("file_path").limit(25)


@plan("select id, title, doi from papers where file_path = (select min(file_path) from papers)")
def src14_paper_by_path(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers")
    return p.join(p.agg(F.min("file_path").alias("file_path")), "file_path", "left_semi").select("id", "title", "doi")


@plan("select id, created_at from papers order by created_at desc, id desc limit 50 offset 100")
def t01_newest_page(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).offset(100).limit(50)


@plan("select id, paper_type from papers where paper_type = 'published'")
def flt01_by_type(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").where(F.col("paper_type") == "published").select("id", "paper_type")


@plan(r"""select id, case when length(coalesce(title, '')) < 5 then 'title_short' when length(title) > 300 then 'title_long'
  when not regexp_matches(coalesce(authors, ''), '"[^"]{2,}"') then 'no_author' when regexp_matches(authors, '"[0-9 ]+"') then 'numeric_author'
  when length(trim(coalesce(abstract, ''))) < 200 then 'text_short' end as reason from papers""")
def flt02_first_reason(s: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("title", F.lit("")))
    reason = (
        F.when(n < 5, "title_short").when(n > 300, "title_long").when(~F.coalesce("authors", F.lit("")).rlike('"[^"]{2,}"'), "no_author")
        .when(F.col("authors").rlike('"[0-9 ]+"'), "numeric_author").when(F.length(F.trim(F.coalesce("abstract", F.lit("")))) < 200, "text_short")
    )
    return table(s, d, "papers").select("id", reason.alias("reason"))


@plan(r"""select id, coalesce(length(title) between 5 and 500 and not regexp_matches(title, '^[\p{N}\p{P}\s]+$') and not regexp_matches(title, '^\p{Lu}+$')
  and not regexp_matches(title, '[\x00-\x1f]'), false) as valid from papers""")
def flt03_valid_title(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    ok = F.length(t).between(5, 500) & ~t.rlike(r"^[\p{N}\p{P}\s]+$") & ~t.rlike(r"^\p{Lu}+$") & ~t.rlike(r"[\x00-\x1f]")
    return table(s, d, "papers").select("id", F.coalesce(ok, F.lit(False)).alias("valid"))


@plan(r"select id, length(authors) between 5 and 1000 and not regexp_matches(authors, '^[\[\]\", 0-9]*$') as valid from papers")
def flt04_valid_authors(s: SparkSession, d: str) -> DataFrame:
    a = F.col("authors")
    return table(s, d, "papers").select("id", (F.length(a).between(5, 1000) & ~a.rlike(r'^[\[\]", 0-9]*$')).alias("valid"))


@plan(r"""select id, coalesce(length(title) < 8 or length(title) > 300 or regexp_matches(lower(title), '^(abstract|contents|index|page [0-9]+|untitled|microsoft word|copyright)')
  or (length(title) > 10 and length(regexp_replace(title, '[^\p{L}]', '', 'g')) * 1.0 / length(title) < 0.5), true) as garbage from papers""")
def flt05_garbage_title(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    bad = (F.length(t) < 8) | (F.length(t) > 300) | F.lower(t).rlike(r"^(abstract|contents|index|page [0-9]+|untitled|microsoft word|copyright)") | ((F.length(t) > 10) & (letters / F.length(t) < 0.5))
    return table(s, d, "papers").select("id", F.coalesce(bad, F.lit(True)).alias("garbage"))


@plan("""select id, case when contains(t, 'withdrawn') or contains(t, 'corrigendum') then false when contains(t, 'stochastic') or contains(t, 'ergodic') then true end as verdict
  from (select id, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) t from papers)""")
def flt06_semantic_rule(s: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    p = table(s, d, "papers").select("id", t.alias("t"))
    return p.select("id", F.when(F.contains("t", F.lit("withdrawn")) | F.contains("t", F.lit("corrigendum")), False).when(F.contains("t", F.lit("stochastic")) | F.contains("t", F.lit("ergodic")), True).alias("verdict"))


@plan(r"select id, trim(regexp_replace(title, '\s+', ' ', 'g')) as fixed from papers where title is distinct from trim(regexp_replace(title, '\s+', ' ', 'g'))")
def flt09_changed_titles(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("id", "title", tx.spaces("title").alias("fixed"))
    return p.where(~F.col("title").eqNullSafe(F.col("fixed"))).select("id", "fixed")


@plan(rf"""select id, y as year, cast(2026 - y as integer) as age from (select id, try_cast(nullif(regexp_extract(publication_date, '(1[89]\d\d|20\d\d)', 1), '') as integer) y from papers) where y <= 2021""")
def flt10_aged(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("id", tx.year("publication_date").alias("year"))
    return p.where("year <= 2021").select("id", "year", (F.lit(2026) - F.col("year")).alias("age"))


@plan("select file_path from pdf_cache c where not exists (select 1 from papers p where p.file_path = c.file_path)")
def flt12_missing_files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_cache").select("file_path").join(table(s, d, "papers").select("file_path"), "file_path", "left_anti")


@plan("""select p.id, case when coalesce(p.file_size, 0) = 0 then 'CORRUPTED' when c.file_path is null then 'NOT_READ' when length(c.text_extract) < 200 then 'NEEDS_OCR'
  when c.quality_score < 0.5 then 'LOW_QUALITY' else 'VALID' end as status from papers p left join pdf_cache c using (file_path)""")
def flt13_status(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "pdf_cache").select("file_path", F.length("text_extract").alias("n"), "quality_score", F.lit(True).alias("read"))
    j = table(s, d, "papers").select("id", "file_path", "file_size").join(c, "file_path", "left")
    status = F.when(F.coalesce("file_size", F.lit(0)) == 0, "CORRUPTED").when(F.col("read").isNull(), "NOT_READ").when(F.col("n") < 200, "NEEDS_OCR").when(F.col("quality_score") < 0.5, "LOW_QUALITY").otherwise("VALID")
    return j.select("id", status.alias("status"))


@plan("select id from papers where starts_with(lower(doi), '10.5555/a') or contains(lower(coalesce(journal, '')), 'letters')")
def flt14_repository(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").where(F.startswith(F.lower("doi"), F.lit("10.5555/a")) | F.contains(F.lower(F.coalesce("journal", F.lit(""))), F.lit("letters"))).select("id")


RULES = [("mail", r"[\w.+-]+@[\w-]+\.\w+"), ("traversal", r"\.\./"), ("script", r"<script"), ("token", r"\b(key|secret|password)\s*[=:]"), ("link", r"https?://")]


@plan("with rules(rule, pattern) as (values " + ", ".join(f"('{n}', '{p}')" for n, p in RULES) + r"""), l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents)
  select doc_id, cast(line_no as bigint) line_no, rule from l, rules where regexp_matches(line, pattern)""")
def flt16_rule_scan(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in RULES)))
    return lines.select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), F.explode(hits).alias("rule"))


@plan(r"select id, not regexp_matches(title, '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{00ad}\x{202a}-\x{202e}]') and not (regexp_matches(title, '[a-zA-Z]') and regexp_matches(title, '[\x{0400}-\x{04ff}]')) as safe from papers where title is not null")
def flt17_safe_unicode(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    bad = t.rlike("[​‌‍⁠﻿­‪-‮]") | (t.rlike("[a-zA-Z]") & t.rlike("[Ѐ-ӿ]"))
    return table(s, d, "papers").where(t.isNotNull()).select("id", (~bad).alias("safe"))


NAMES = """select id, unnest(from_json(authors, '["VARCHAR"]')) name from papers"""


@plan(rf"select name, length(name) >= 3 and regexp_matches(trim(name), '\s') and not regexp_matches(name, '[0-9]') and length(name) - length(replace(name, '.', '')) <= 2 and regexp_matches(name, '^\p{{Lu}}') as well_formed from (select distinct name from ({NAMES}))")
def flt18_well_formed_names(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "papers").select(F.explode(tx.author_list("authors")).alias("name")).distinct()
    x = F.col("name")
    ok = (F.length(x) >= 3) & F.trim(x).rlike(r"\s") & ~x.rlike("[0-9]") & (F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))) <= 2) & x.rlike(r"^\p{Lu}")
    return n.select("name", ok.alias("well_formed"))


@plan("select v.id, a.title as original_title, b.title as updated_title, v.version_type from versions v join papers a on a.id = v.original_paper_id join papers b on b.id = v.updated_paper_id")
def j02_version_titles(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("id", "title")
    v = table(s, d, "versions").withColumnRenamed("id", "v_id")
    j = v.join(p.select(F.col("id").alias("original_paper_id"), F.col("title").alias("original_title")), "original_paper_id").join(p.select(F.col("id").alias("updated_paper_id"), F.col("title").alias("updated_title")), "updated_paper_id")
    return j.select(F.col("v_id").alias("id"), "original_title", "updated_title", "version_type")


BLOCK = r"""with p as (select id, list_extract(from_json(authors, '["VARCHAR"]'), 1) a, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) t from papers),
  k as (select t, lower(a) block, min(id) id, count(*) n from p where a is not null and length(t) > 0 group by all)"""


@plan(BLOCK + """ select a.id id_a, b.id id_b, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 4) similarity from k a join k b on a.block = b.block and a.id < b.id
  where least(length(a.t), length(b.t)) >= 0.6 * greatest(length(a.t), length(b.t)) and levenshtein(a.t, b.t) <= 0.1 * greatest(length(a.t), length(b.t))""")
def j03_blocked_fuzzy(s: SparkSession, d: str) -> DataFrame:
    t = tx.ascii_form("title")
    p = table(s, d, "papers").select("id", F.lower(F.try_element_at(tx.author_list("authors"), F.lit(1))).alias("block"), t.alias("t"))
    return joins.blocked_pairs(p, "id", "block", "t", 0.9)


@plan(r"""with g as (select lower(file_hash) k, id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) t from papers where trim(coalesce(file_hash, '')) <> '' and file_size > 0)
  select a.id, count(*) as peers from g a join g b on a.k = b.k and a.id <> b.id where levenshtein(a.t, b.t) <= 0.15 * greatest(length(a.t), length(b.t)) group by a.id""")
def j04_consensus_peers(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "papers").where((F.trim(F.coalesce("file_hash", F.lit(""))) != "") & (F.col("file_size") > 0)).select(F.lower("file_hash").alias("k"), "id", tx.ascii_form(F.coalesce("title", F.lit(""))).alias("t"))
    return joins.agreeing_peers(g, "k", "id", "t", 0.85)


@plan("""select coalesce(p.file_path, c.file_path) file_path, p.id, c.library_used, case when p.id is null then 'cache_only' when c.file_path is null then 'papers_only' else 'both' end as side
  from papers p full join pdf_cache c on p.file_path = c.file_path""")
def j06_merge_reports(s: SparkSession, d: str) -> DataFrame:
    p, c = table(s, d, "papers").select("file_path", "id"), table(s, d, "pdf_cache").select("file_path", "library_used", F.lit(True).alias("c"))
    side = F.when(F.col("id").isNull(), "cache_only").when(F.col("c").isNull(), "papers_only").otherwise("both")
    return p.join(c, "file_path", "full").select("file_path", "id", "library_used", side.alias("side"))


@plan(f"select s as source, t.trust_rank, case when s is null then 'missing' when t.source is null then 'unknown' when s = p.source then 'canonical' else 'variant' end as verdict, count(*) as n from (select source, {SRC} s from papers) p left join source_trust t on t.source = s group by all")
def j07_dictionary_lookup(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select(F.col("source").alias("raw"), source_of().alias("source"))
    t = table(s, d, "source_trust").withColumn("hit", F.lit(True))
    v = F.when(F.col("source").isNull(), "missing").when(F.col("hit").isNull(), "unknown").when(F.col("source") == F.col("raw"), "canonical").otherwise("variant")
    return p.join(t, "source", "left").groupBy("source", "trust_rank", v.alias("verdict")).agg(F.count("*").alias("n"))


@plan("""with m as (select distinct trim(regexp_replace(lower(name), '[^a-z.,'' -]', '', 'g')) name from (select unnest(from_json(authors, '["VARCHAR"]')) name from papers)), n as (select n_name as entry from nation)
  select name, entry, round(1 - levenshtein(name, lower(entry)) / greatest(length(name), length(entry)), 4) similarity from m, n where name <> '' qualify row_number() over (partition by name order by round(1 - levenshtein(name, lower(entry)) / greatest(length(name), length(entry)), 4) desc, entry) <= 5""")
def j08_nearest_names(s: SparkSession, d: str) -> DataFrame:
    """The five entries of a dictionary nearest to each author's name (its ASCII letters: the SQL counts bytes)."""
    m = table(s, d, "papers").select(F.explode(F.from_json("authors", "array<string>")).alias("name")).select(F.trim(tx.sub(F.lower("name"), "[^a-z.,' -]")).alias("name")).where("name <> ''").distinct()
    return joins.nearest(m, "name", table(s, d, "nation").select(F.col("n_name").alias("entry")), "entry", 5)


@plan(r"""with w as (select distinct unnest(regexp_extract_all(lower(title), '\p{L}{3,}')) w from papers), n as (select distinct unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) n from documents) select w as word, n as name from w, n where regexp_matches(w, '^[a-z]+$') and regexp_matches(n, '^[a-z]+$') and abs(length(w) - length(n)) <= 1 and case when abs(length(w) - length(n)) <= 1 then levenshtein(w, n) = 1 end""")
def j09_one_edit(s: SparkSession, d: str) -> DataFrame:
    """Words of titles one edit from a word of the documents (ASCII words: the SQL counts bytes)."""
    words = lambda c: F.explode(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{3,}"), 0), lambda w: w.rlike("^[a-z]+$")))
    p, t = table(s, d, "papers"), table(s, d, "documents")
    return joins.one_edit(p.select(words("title").alias("word")).distinct(), "word", t.select(words("text").alias("name")).distinct(), "name")


@plan("""with inc as (select file_path, max(file_size) file_size from pdf_cache group by 1) select coalesce(p.file_path, i.file_path) file_path, p.id, p.created_at, coalesce(i.file_size, p.file_size) as file_size,
  case when p.id is null then 'insert' when i.file_path is null then 'keep' else 'update' end as action from papers p full join inc i using (file_path)""")
def j10_upsert(s: SparkSession, d: str) -> DataFrame:
    return joins.upsert(table(s, d, "papers").select("file_path", "id", "created_at", "file_size"), table(s, d, "pdf_cache").groupBy("file_path").agg(F.max("file_size").alias("file_size")), "file_path", keep=["id", "created_at"])


@plan("select p.id, c.file_path is not null as hit from papers p left join pdf_cache c on p.file_path = c.file_path and p.file_size = c.file_size")
def j12_cache_hits(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "pdf_cache").select("file_path", "file_size", F.lit(True).alias("h")).distinct()
    return table(s, d, "papers").join(c, ["file_path", "file_size"], "left").select("id", F.col("h").isNotNull().alias("hit"))


@plan("""with r as (select doc_id, source, text, row_number() over (partition by source order by doc_id) rn from documents where source is not null and text is not null)
  select a.doc_id doc_a, b.doc_id doc_b from r a join r b on a.source = b.source and b.rn between a.rn + 1 and a.rn + 49 where a.text <> b.text
  and case when abs(length(a.text) - length(b.text)) <= floor(0.08 * greatest(length(a.text), length(b.text))) then levenshtein(a.text, b.text) <= floor(0.08 * greatest(length(a.text), length(b.text))) else false end""")
def j13_band_pairs(s: SparkSession, d: str) -> DataFrame:
    """Near duplicates among the 49 next documents of a source, by whole texts."""
    return joins.band_pairs(table(s, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text", 49, 0.92)


@plan(r"""select doc_id from (select doc_id, row_number() over (partition by md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) order by doc_id) rn from documents where text is not null) where rn = 1""")
def j14_first_of_equal(s: SparkSession, d: str) -> DataFrame:
    k = F.md5(F.trim(tx.sub(F.lower("text"), r"[^\p{L}\p{N}]+", " ")))
    return table(s, d, "documents").where("text is not null").groupBy(k.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@plan("""select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 5) score from embeddings q, embeddings v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id
  qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 5) desc, v.vec_id) <= 5""")
def j15_nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return joins.nearest_vectors(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@plan(r"""with p as (select id, lower(regexp_extract(doi, '(10\.\d{4,9}/[^\s]+)', 1)) d, nullif(trim(arxiv_id), '') a from papers) select id, coalesce(min(id) over (partition by a) filter (a is not null), id) as by_arxiv, case when d <> '' then min(id) over (partition by d) else id end as by_doi from p""".replace("coalesce(min(id) over (partition by a) filter (a is not null), id)", "case when a is not null then min(id) over (partition by a) else id end"))
def j16_identifier_cascade(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("id", F.lower(F.regexp_extract("doi", r"(10\.\d{4,9}/[^\s]+)", 1)).alias("d"), F.when(F.trim("arxiv_id") != "", F.trim("arxiv_id")).alias("a"))
    first = lambda c, n: p.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).agg(F.min("id").alias(n))
    j = p.join(first("a", "fa"), "a", "left").join(first("d", "fd"), "d", "left")
    return j.select("id", F.coalesce("fa", "id").alias("by_arxiv"), F.coalesce("fd", "id").alias("by_doi"))


@plan("select p.id, contains(lower(c.text_extract), lower(p.title)) as contained from papers p join pdf_cache c using (file_path) where p.title is not null")
def j17_title_in_text(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "papers").where("title is not null").select("file_path", "id", "title").join(table(s, d, "pdf_cache").select("file_path", "text_extract"), "file_path")
    return j.select("id", F.contains(F.lower("text_extract"), F.lower("title")).alias("contained"))


@plan(f"""select id from (select id, row_number() over (partition by coalesce(nullif(lower(trim(doi)), ''), lower(trim(title)), cast(id as varchar)) order by coalesce(t.trust_rank, 99), id) rn from (select *, {SRC} s from papers) p left join source_trust t on t.source = p.s) where rn = 1""")
def j18_first_by_identifier(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("id", "doi", "title", source_of().alias("source")).join(table(s, d, "source_trust"), "source", "left")
    k = F.coalesce(F.when(F.trim("doi") != "", F.lower(F.trim("doi"))), F.lower(F.trim("title")), F.col("id").cast("string"))
    return p.groupBy(k.alias("k")).agg(F.min_by("id", F.struct(F.coalesce("trust_rank", F.lit(99)), "id")).alias("id")).select("id")


@plan("select source from mix_targets except select source from documents")
def u01_expected_not_actual(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mix_targets").select("source").subtract(table(s, d, "documents").select("source"))


@plan("select source from mix_targets intersect select source from documents")
def u01_expected_and_actual(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mix_targets").select("source").intersect(table(s, d, "documents").select("source"))


@plan("select origin, count(*) as n from (select 'papers' origin, title from papers union all select 'records', title from metadata_records) group by 1")
def u02_union_sources(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "papers").select(F.lit("papers").alias("origin"), "title").unionByName(table(s, d, "metadata_records").select(F.lit("records").alias("origin"), "title"))
    return a.groupBy("origin").agg(F.count("*").alias("n"))


@plan("select doc_id, case when k % 100 < 90 then 'train' when k % 100 < 95 then 'valid' else 'test' end as part from (select doc_id, cast('0x' || substr(md5(cast(doc_id as varchar) || '-42'), 1, 7) as bigint) k from documents)")
def u05_split(s: SparkSession, d: str) -> DataFrame:
    k = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42"))), 1, 7), 16, 10).cast("long") % 100
    return table(s, d, "documents").select("doc_id", F.when(k < 90, "train").when(k < 95, "valid").otherwise("test").alias("part"))


@plan("select base, max(v) as latest, count(*) as versions from (select regexp_extract(arxiv_id, '^([^v]+)', 1) base, coalesce(try_cast(nullif(regexp_extract(arxiv_id, 'v(\\d+)$', 1), '') as integer), 1) v from papers where trim(arxiv_id) <> '') group by 1")
def w04_latest_versions(s: SparkSession, d: str) -> DataFrame:
    v = F.regexp_extract("arxiv_id", r"v(\d+)$", 1)
    p = table(s, d, "papers").where(F.trim("arxiv_id") != "").select(F.regexp_extract("arxiv_id", "^([^v]+)", 1).alias("base"), F.when(v != "", v.cast("int")).otherwise(1).alias("v"))
    return p.groupBy("base").agg(F.max("v").alias("latest"), F.count("*").alias("versions"))


@plan("""select id, first_value(id) over w as keep_id from (select id, lower(file_hash) k, file_path, case when regexp_matches(file_path, 'copy|_v\\d|\\(1\\)') then 1 else 0 end bad from papers where trim(coalesce(file_hash, '')) <> '')
  window w as (partition by k order by bad, file_path rows between unbounded preceding and unbounded following) qualify id <> first_value(id) over w""")
def w06_removals(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").where(F.trim(F.coalesce("file_hash", F.lit(""))) != "").select("id", F.lower("file_hash").alias("k"), "file_path", F.col("file_path").rlike(r"copy|_v\d|\(1\)").cast("int").alias("bad"))
    keep = p.groupBy("k").agg(F.min_by("id", F.struct("bad", "file_path")).alias("keep_id"))
    return p.join(keep, "k").where("id <> keep_id").select("id", "keep_id")


@plan("select file_path from pdf_cache where created_at >= (select max(created_at) from pdf_cache) - 90 * 86400 order by access_count desc, last_access desc, file_path limit 100")
def w08_cache_keep(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "pdf_cache")
    fresh = c.crossJoin(c.agg(F.max("created_at").alias("newest"))).where("created_at >= newest - 90 * 86400")  # one row
    return fresh.orderBy(F.desc("access_count"), F.desc("last_access"), "file_path").limit(100).select("file_path")


@plan("select file_path, event_kind, ts from (select distinct event_id, file_path, event_kind, ts from file_events) qualify row_number() over (partition by file_path order by ts desc, event_id desc) = 1")
def w10_last_event(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "file_events")
    return e.groupBy("file_path").agg(F.max_by(F.struct("event_kind", "ts"), F.struct("ts", "event_id")).alias("v")).select("file_path", "v.event_kind", "v.ts")


@plan(f"select s as source, rank() over (order by avg(confidence) desc) as rank from (select {SRC} s, confidence from papers where confidence between 0 and 1 and not isnan(confidence)) where s is not null group by s".replace("avg(confidence)", "round(avg(confidence), 6)"))
def w12_ranked_sources(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "papers").where("confidence between 0 and 1 and not isnan(confidence)").groupBy(source_of().alias("source")).agg(F.round(F.avg("confidence"), 6).alias("m")).where("source is not null")
    return g.select("source", F.rank().over(Window.orderBy(F.desc("m"))).cast("long").alias("rank"))


QUERIES, SQL = plan.queries, plan.sql
