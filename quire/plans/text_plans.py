"""Text: normal forms, cleaning, tokens, extraction (N, C, X, E of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import table
from .registry import Plans

plan = Plans()
G = "'g'"


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


def papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


@plan(None)
def n01_folded_titles(s: SparkSession, d: str) -> DataFrame:
    """Accents dropped, lower case: needs Unicode normalisation, thus a vectorised function."""
    return papers(s, d).select("id", tx.folded("title").alias("form"))


@plan(r"select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\$[^$]*\$', ' ', 'g'), '\\[A-Za-z]+\{([^{}]*)\}', '\1', 'g'), '\\[A-Za-z]+', ' ', 'g'), '[{}]', '', 'g'), '\s+', ' ', 'g')) as form from papers")
def n11_plain_latex(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.plain_latex("title").alias("form"))


@plan("select id, nfc_normalize(title) as form from papers")
def n05_composed(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.composed("title").alias("form"))


@plan(r"select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[‐‑‒–—―−]', '-', 'g'), '[‘’‚‛]', '''', 'g'), '[“”„‟]', '\"', 'g'), '\s+', ' ', 'g')) as form from papers".replace('\\"', '"'))
def n07_even_marks(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.spaces(tx.even_marks("title")).alias("form"))


@plan(r"select id, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(title, '\s*,\s*', ', ', 'g'), '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'))), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) as form from papers")
def n08_scoring_form(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.scoring_form("title").alias("form"))


@plan(r"select id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) as form from papers")
def n09_ascii_form(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.ascii_form("title").alias("form"))


NAMES = """(select distinct unnest(from_json(authors, '["VARCHAR"]')) as name from papers)"""


@plan(r"select name, regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '\s+', ' ', 'g')), '^[.,;:!?''\"()\[\]{}-]+|[.,;:!?''\"()\[\]{}-]+$', '', 'g'), '^(dr|prof|professor)\.?\s+', '') as form from ".replace('\\"', '"') + NAMES)
def n10_author_form(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select(F.explode(tx.author_list("authors")).alias("name")).distinct().select("name", tx.author_form("name").alias("form"))


@plan(r"select id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\.[A-Za-z0-9]{1,4}$', ''), '[‐‑‒–—―−]', '-', 'g')), '\s+', ' ', 'g')) as form from papers")
def n12_stem_form(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.stem_form("file_path").alias("form"))


@plan(r"select id, regexp_replace(regexp_replace(title, '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{00ad}]', '', 'g'), '[\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]', '', 'g') as form from papers")
def n16_without_hidden(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.without_hidden("title").alias("form"))


@plan("with h(ch, latin) as (values ('а', 'a'), ('е', 'e'), ('о', 'o'), ('р', 'p'), ('с', 'c'), ('х', 'x'), ('у', 'y'), ('і', 'i'), ('ѕ', 's')), t as (select id, unnest(string_split(title, '')) ch, generate_subscripts(string_split(title, ''), 1) pos from papers) select id, cast(pos as bigint) as at, ch, latin from t join h using (ch)")
def n17_lookalikes(s: SparkSession, d: str) -> DataFrame:
    h = s.createDataFrame([("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("х", "x"), ("у", "y"), ("і", "i"), ("ѕ", "s")], "ch string, latin string")
    chars = papers(s, d).where("title is not null").select("id", F.posexplode(F.split("title", "")).alias("k", "ch"))
    return chars.join(F.broadcast(h), "ch").select("id", (F.col("k") + 1).cast("long").alias("at"), "ch", "latin")


@plan(r"""select id, case when x = '' then 'unnamed' else x end as form from (select id, regexp_replace(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') x from papers)""")
def n18_safe_name(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.safe_name("title").alias("form"))


@plan(r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[\w.+-]+@[\w-]+\.[\w.]+', ' ', 'g'), '\[\d+(,\s*\d+)*\]', ' ', 'g'), '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{00ad}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]', '', 'g'), '[‐‑‒–—―−]', '-', 'g'), '[‘’‚‛]', '''', 'g'), '[“”„‟]', '\"', 'g'), '\s+', ' ', 'g')) as form from documents where text is not null".replace('\\"', '"'))
def c01_clean_text(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", tx.clean("text").alias("form"))


@plan(r"select file_path, len(list_filter(string_split(text_extract, chr(10)), lambda x: not regexp_matches(x, '^\s*\d+\s*$') and not regexp_matches(x, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$') and not starts_with(x, 'Figure '))) as kept_lines from pdf_cache")
def c02_kept_lines(s: SparkSession, d: str) -> DataFrame:
    keep = F.filter(F.split("text_extract", "\n"), lambda x: ~x.rlike(r"^\s*\d+\s*$") & ~x.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") & ~F.startswith(x, F.lit("Figure ")))
    return table(s, d, "pdf_cache").select("file_path", F.size(keep).cast("long").alias("kept_lines"))


@plan(r"select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+'), lambda x: trim(x)), lambda x: length(x) > 5)) as sentences from documents where text is not null")
def c03_sentences(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.size(tx.sentences("text")).cast("long").alias("sentences"))


@plan(r"select doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.\w+')) as mails, len(regexp_extract_all(text, '\d+')) as numbers, round(length(regexp_replace(text, '\s', '', 'g')) * 1.0 / greatest(length(text), 1), 4) as dense from documents where text is not null")
def c04_clean_stats(s: SparkSession, d: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return docs(s, d).select("doc_id", count(r"[\w.+-]+@[\w-]+\.\w+").alias("mails"), count(r"\d+").alias("numbers"), F.round(F.length(tx.sub("text", r"\s")) / F.greatest(F.length("text"), F.lit(1)), 4).alias("dense"))


@plan(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\.{3}', '…', 'g'), 'ﬁ', 'fi', 'g'), 'ﬂ', 'fl', 'g') as form from documents where text is not null and regexp_matches(text, '\.{3}|ﬁ|ﬂ')")
def x06_ellipsis_ligatures(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).where(F.col("text").rlike(r"\.{3}|ﬁ|ﬂ")).select("doc_id", tx.sub(tx.sub(tx.sub("text", r"\.{3}", "…"), "ﬁ", "fi"), "ﬂ", "fl").alias("form"))


@plan("select doc_id, length(text) - length(replace(text, '(', '')) - length(text) + length(replace(text, ')', '')) as balance, length(text) - length(replace(text, '$', '')) as dollars from documents where text is not null")
def x07_bracket_balance(s: SparkSession, d: str) -> DataFrame:
    n = lambda ch: F.length("text") - F.length(F.replace("text", F.lit(ch), F.lit("")))
    return docs(s, d).select("doc_id", (n("(") - n(")")).cast("long").alias("balance"), n("$").cast("long").alias("dollars"))


@plan(r"select id, unnest(regexp_extract_all(title, '\p{L}+[-–]\p{L}+')) as compound from papers")
def x08_dash_compounds(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", F.explode(F.regexp_extract_all("title", F.lit(r"\p{L}+[-–]\p{L}+"), 0)).alias("compound"))


@plan(r"with w as (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w from documents), k as (select w, count(*) n from w group by 1) select w as word, n from k where n = 1 and length(w) > 3")
def x11_unknown_words(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.explode(tx.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n = 1 and length(word) > 3")


@plan(r"select doc_id, len(regexp_extract_all(text, '[\p{L}]+')) as words, len(regexp_extract_all(text, '\p{N}+')) as numbers, len(regexp_extract_all(text, '\$[^$]*\$')) as formulas, len(regexp_extract_all(text, '\b\p{Lu}{2,}\b')) as capitals from documents where text is not null")
def e01_token_kinds(s: SparkSession, d: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return docs(s, d).select("doc_id", count(r"[\p{L}]+").alias("words"), count(r"\p{N}+").alias("numbers"), count(r"\$[^$]*\$").alias("formulas"), count(r"\b\p{Lu}{2,}\b").alias("capitals"))


@plan(r"select w as word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w from documents) where length(w) >= 3 group by 1")
def e02_word_counts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.explode(tx.words("text", 3)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@plan(r"""select id, nullif(regexp_replace(lower(regexp_extract(doi, '(10\.\d{4,9}/[^\s"<>]+)', 1)), '[.,;)]+$', ''), '') as doi from papers""")
def e03_dois(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.doi(F.lower("doi")).alias("doi"))


@plan(r"select id, nullif(regexp_extract(arxiv_id, '(\d{4}\.\d{4,5}|[a-z-]+/\d{7})', 1), '') as base, try_cast(nullif(regexp_extract(arxiv_id, '(\d{4}\.\d{4,5}|[a-z-]+/\d{7})v(\d+)', 2), '') as integer) as version from papers")
def e04_arxiv_ids(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select("id", tx.arxiv("arxiv_id").alias("a")).select("id", "a.base", "a.version")


@plan(r"select id, split_part(f, ' - ', 1) as author_part, split_part(f, ' - ', 2) as title_part from (select id, regexp_replace(regexp_replace(file_path, '^.*/', ''), '\.pdf$', '') f from papers)")
def e06_filename_parts(s: SparkSession, d: str) -> DataFrame:
    f = tx.sub(tx.sub("file_path", "^.*/"), r"\.pdf$")
    return papers(s, d).select("id", F.split_part(f, F.lit(" - "), F.lit(1)).alias("author_part"), F.split_part(f, F.lit(" - "), F.lit(2)).alias("title_part"))


@plan(r"select family, count(*) as n from (select case when contains(name, ',') then trim(split_part(name, ',', 1)) else regexp_extract(trim(name), '(\S+)$', 1) end family from (select unnest(from_json(authors, '[" + '"VARCHAR"' + r"]')) as name from papers)) group by 1")
def e07_family_names(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).select(F.explode(tx.author_list("authors")).alias("name")).groupBy(tx.family(F.col("name")).alias("family")).agg(F.count("*").alias("n"))


@plan(r"select id, try_cast(nullif(regexp_extract(publication_date, '(1[89]\d\d|20\d\d)', 1), '') as integer) as year, nullif(regexp_extract(pages, '^(\d+)', 1), '') as first_page from papers")
def e08_publication_info(s: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract("pages", r"^(\d+)", 1)
    return papers(s, d).select("id", tx.year("publication_date").alias("year"), F.when(p != "", p).alias("first_page"))


@plan(r"with l as (select file_path, unnest(string_split(text_extract, chr(10))) line, generate_subscripts(string_split(text_extract, chr(10)), 1) k from pdf_cache) select file_path, cast(k as bigint) as line_no, line from l where k <= 10 and length(trim(line)) between 15 and 200 qualify row_number() over (partition by file_path order by least(length(line), 60) + case when regexp_matches(line, '[.;]$') then -30 else 0 end desc, k) = 1")
def e09_title_line(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "pdf_cache").select("file_path", F.posexplode(F.slice(F.split("text_extract", "\n"), 1, 10)).alias("k", "line")).where(F.length(F.trim("line")).between(15, 200))
    score = F.least(F.length("line"), F.lit(60)) + F.when(F.col("line").rlike("[.;]$"), -30).otherwise(0)
    return l.groupBy("file_path").agg(F.max_by(F.struct((F.col("k") + 1).cast("long").alias("line_no"), "line"), F.struct(score, -F.col("k"))).alias("v")).select("file_path", "v.*")


@plan(r"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))), ' ') as text from documents where text is not null and text <> ''")
def e10_rebuilt_from_index(s: SparkSession, d: str) -> DataFrame:
    """Words of an inverted index put back in their order (here the index's own)."""
    w = docs(s, d).where("text <> ''").select("doc_id", F.explode(tx.words("text")).alias("w")).distinct()
    return w.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("text"))


@plan(r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]+>', ' ', 'g'), '&amp;', '&', 'g'), '\s+', ' ', 'g')) as plain from documents where text is not null")
def e12_markup_text(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", tx.spaces(tx.sub(tx.sub("text", r"<[^<>]+>", " "), "&amp;", "&")).alias("plain"))


@plan(r"with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w from documents where text is not null) select doc_id, len(list_filter(list_zip(w[1:-2], w[2:]), lambda x: x[1] = x[2])) as repeats from t where len(w) > 1")
def w03_repeated_words(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).select("doc_id", tx.words("text").alias("w")).where(F.size("w") > 1)
    same = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: a == b)
    return t.select("doc_id", F.size(F.filter(same, lambda x: x)).cast("long").alias("repeats"))


@plan(r"with t as (select id, regexp_extract_all(lower(title), '[\p{L}\p{N}_]+') w from papers), g as (select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) gram from t where len(w) > 1) select gram, count(distinct id) as n from g group by 1 having count(distinct id) > 1")
def w11_title_bigrams(s: SparkSession, d: str) -> DataFrame:
    g = papers(s, d).select("id", F.explode(tx.ngrams(tx.words("title"), 2)).alias("gram")).distinct()
    return g.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")


@plan(r"select doc_id, word, n from (select doc_id, w as word, count(*) n from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w from documents) where length(w) > 6 group by all having count(*) > 1) qualify row_number() over (partition by doc_id order by n desc, word) <= 10")
def t02_keywords(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k = docs(s, d).select("doc_id", F.explode(tx.words("text", 7)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n")).where("n > 1")
    return k.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).where("rn <= 10").drop("rn")


@plan(r"select id, len(regexp_extract_all(title, '\p{Cc}')) as controls, length(title) - length(replace(title, chr(65533), '')) as lost from papers where title is not null")
def y30_encoding_issues(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).where("title is not null").select("id", F.regexp_count("title", F.lit(r"\p{Cc}")).cast("long").alias("controls"), (F.length("title") - F.length(F.replace("title", F.lit("�"), F.lit("")))).cast("long").alias("lost"))


@plan("select id, replace(replace(replace(replace(title, 'α', 'alpha'), 'Γ', 'Gamma'), '²', '^2'), '–', '-') as form from papers")
def y31_math_symbols(s: SparkSession, d: str) -> DataFrame:
    form = F.col("title")
    for a, b in (("α", "alpha"), ("Γ", "Gamma"), ("²", "^2"), ("–", "-")):
        form = F.replace(form, F.lit(a), F.lit(b))
    return papers(s, d).select("id", form.alias("form"))


@plan(r"select id, sha256(source || ':' || lower(regexp_replace(regexp_replace(doi, '^https?://doi\.org/', ''), '^doi:', ''))) as cache_key from papers")
def y33_cache_key(s: SparkSession, d: str) -> DataFrame:
    i = F.lower(tx.sub(tx.sub("doi", r"^https?://doi\.org/"), "^doi:"))
    return papers(s, d).select("id", F.sha2(F.concat(F.col("source"), F.lit(":"), i), 256).alias("cache_key"))


@plan(r"select doc_id, len(list_filter(regexp_extract_all(text, '[\p{L}]+'), lambda w: length(w) > 15)) as long_words, len(regexp_extract_all(text, '\[\d+\]')) as citations from documents where text is not null")
def y36_patterns(s: SparkSession, d: str) -> DataFrame:
    w = F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), 0), lambda x: F.length(x) > 15)
    return docs(s, d).select("doc_id", F.size(w).cast("long").alias("long_words"), F.regexp_count("text", F.lit(r"\[\d+\]")).cast("long").alias("citations"))


@plan(r"select id, regexp_matches(title, '[\x{0370}-\x{03ff}]') as greek from papers where title is not null")
def y46_has_greek(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).where("title is not null").select("id", F.col("title").rlike("[Ͱ-Ͽ]").alias("greek"))


QUERIES, SQL = plan.queries, plan.sql
