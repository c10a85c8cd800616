"""Joins that the engine lacks: fuzzy joins within blocks, nearest names and vectors, bands, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from ..session import cut


DICTIONARY = 100_000  # names that are held against every mention


def blocked_pairs(df: DataFrame, key: str, block: str, text: str, least: float) -> DataFrame:
    """Pairs of distinct texts of one block whose edit ratio is at least ``least``.

    Equal texts of a block are one row (their smallest id) before the join; lengths bound the ratio
    before distances are taken. Rows without a block or text are left out.
    """
    one = df.where(F.col(block).isNotNull() & (F.length(text) > 0)).groupBy(block, text).agg(F.min(key).alias(key))
    a, b = (one.select(block, F.col(key).alias(f"id_{s}"), F.col(text).alias(f"t_{s}")) for s in "ab")
    long, short = F.greatest(F.length("t_a"), F.length("t_b")), F.least(F.length("t_a"), F.length("t_b"))
    room = round(1 - least, 6)
    far = F.expr(f"levenshtein(t_a, t_b, cast(floor({room} * greatest(length(t_a), length(t_b))) as int))")  # -1 beyond
    pairs = a.join(b, block).where((F.col("id_a") < F.col("id_b")) & (short >= 0.6 * long) & (long - short <= room * long)).withColumn("far", far).where("far >= 0")
    far = F.col("far")
    return pairs.select("id_a", "id_b", F.round(1 - far / long, 4).alias("similarity"))


def agreeing_peers(df: DataFrame, group: str, key: str, text: str, least: float) -> DataFrame:
    """For each row, how many others of its group say nearly the same; equal texts are compared once."""
    counts = df.groupBy(group, text).agg(F.count("*").alias("n"))
    a, b = counts.select(group, F.col(text).alias("t_a"), F.col("n").alias("n_a")), counts.select(group, F.col(text).alias("t_b"), F.col("n").alias("n_b"))
    near = a.join(b, group).where(F.levenshtein("t_a", "t_b") <= round(1 - least, 6) * F.greatest(F.length("t_a"), F.length("t_b")))
    peers = near.groupBy(group, F.col("t_a").alias(text)).agg((F.sum("n_b") - 1).alias("peers")).where("peers > 0")
    return df.join(peers, [group, text]).select(key, "peers")


def nearest(mentions: DataFrame, mention: str, names: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` nearest names of a small dictionary (at most ``DICTIONARY`` names) for each distinct mention."""
    if names.count() > DICTIONARY:
        raise ValueError(f"a dictionary of more than {DICTIONARY} names; look words up by one_edit instead")
    a = mentions.crossJoin(F.broadcast(names))
    s = F.round(1 - F.levenshtein(F.lower(mention), F.lower(name)) / F.greatest(F.length(mention), F.length(name)), 4)
    w = Window.partitionBy(mention).orderBy(F.desc("similarity"), name)
    return a.select(mention, name, s.alias("similarity")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def one_edit(words: DataFrame, word: str, names: DataFrame, name: str) -> DataFrame:
    """Words exactly one edit from a name: both meet in forms with one character left out, then are checked."""

    def forms(c: str):
        n = F.length(c)
        return F.explode(F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n))))))

    a, b = words.select(word, forms(word).alias("f")), names.select(name, forms(name).alias("f"))
    return a.join(b, "f").select(word, name).distinct().where(F.levenshtein(word, name) == 1)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Merge by key: values of ``new`` where present, ``keep`` columns always of ``old``; with the action taken."""
    n = new.select(key, *(F.col(c).alias(f"{c}_new") for c in new.columns if c != key), F.lit(True).alias("in_new"))
    j = old.withColumn("in_old", F.lit(True)).join(n, key, "full")
    cols = [F.col(c) if c in keep or f"{c}_new" not in n.columns else F.coalesce(f"{c}_new", c).alias(c) for c in old.columns if c != key]
    return j.select(key, *cols, F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "keep").otherwise("update").alias("action"))


def places(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rn``, its place (from 0) in the order of all rows: ranges are sorted apart, only their sizes meet."""
    r = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = {x["p"]: x["n"] for x in r.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before)]
        before += sizes[p]
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return r.withColumn("rn", (start + F.col("_m").bitwiseAND(F.lit(2**33 - 1))).cast("long")).drop("_m")


def band_pairs(df: DataFrame, key: str, group: str, text: str, width: int, least: float) -> DataFrame:
    """Pairs at most ``width`` places apart in their group's order whose texts differ, with edit ratio ``least``; whole texts.

    A range join made an equi-join: each row stands in the bucket of its place and in the one before, so a group of any
    size is spread over its buckets. Lengths, then counts of characters bound the distance before it is taken.
    """
    letters = "abcdefghijklmnopqrstuvwxyz 0123456789"
    low = F.lower(F.col(text))
    bag = F.transform(F.array(*map(F.lit, letters)), lambda c: F.length(low) - F.length(F.replace(low, c, F.lit(""))))
    r = places(df.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(group, key, text, bag.alias("bag")), group, key)
    bucket = F.floor(F.col("rn") / width)
    a, b = (r.select(group, F.col(key).alias(f"doc_{s}"), F.col("rn").alias(f"r{s}"), F.col(text).alias(f"t{s}"), F.col("bag").alias(f"g{s}"), (bucket if s == "a" else F.explode(F.array(bucket, bucket - 1))).alias("bucket")) for s in "ab")
    pairs = a.join(b.hint("merge"), [group, "bucket"]).where((F.col("rb") > F.col("ra")) & (F.col("rb") <= F.col("ra") + width) & (F.col("ta") != F.col("tb")))
    long = F.greatest(F.length("ta"), F.length("tb"))
    room = F.floor(round(1 - least, 6) * long).cast("int")
    # An edit changes the surplus of either side by one at most.
    surplus = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(p - q, F.lit(0))), F.lit(0), lambda s, v: s + v)
    pairs = pairs.where(F.abs(F.length("ta") - F.length("tb")) <= room).where((surplus("ga", "gb") <= room) & (surplus("gb", "ga") <= room))
    far = F.levenshtein("ta", "tb") if least <= 0 else F.expr(f"levenshtein(ta, tb, cast(floor({round(1 - least, 6)} * greatest(length(ta), length(tb))) as int))")
    return pairs.where((far >= 0) & (far <= room)).select("doc_a", "doc_b")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """word, n: how many texts have each word."""
    return df.select(F.explode(F.array_distinct(F.split(text, " "))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def rare_words(df: DataFrame, key: str, text: str, total: DataFrame, n: int = 3) -> DataFrame:
    """key, word: the ``n`` words of each text that are rarest in ``total`` (word, n); of equals the smaller ones."""
    each = df.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("word")).where("word <> ''").join(total.hint("merge"), "word")
    first = each.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, n).alias("ws"))  # the words of one title
    return first.select(key, F.explode("ws.word").alias("word"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Exact ``k`` nearest by cosine for a stated set of queries; every partition keeps its best before the shuffle."""
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    s = vectors.join(F.broadcast(q) if queries.count() <= 100_000 else q, F.col(key) != F.col("query_id"))
    s = s.select("query_id", key, F.round(cosine(F.col("q"), F.col(vector)), 5).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return s.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
