"""Best representative of each duplicate group (problem 2).

Two operators. ``survivors`` takes, field by field, the value of the best row that fills the field
(trust of its source, confidence, recency, id); it is one aggregation of minima, so groups of any
size are combined before the shuffle. ``consensus`` chooses among the values of one field by voting:
the distinct values of a group, weighted by trust, are aligned token by token into a profile
(progressive alignment), every column votes, and the existing value closest to the result survives.
Profiles are built from at most ``CHUNK`` values and merged in turn, so no task holds a whole group.

The project's statement fixes the order for ``p2_found``, which voting cannot reproduce; therefore
it runs on ``survivors`` and the named method serves ``p2_consensus`` (see the README).

Defined cases: rows without a key, or with one that is blank, or of an empty file, are in no group;
fields with nulls or fillers are not filled; exact ties go to the smallest id; repeated rows are
counted once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table

FIELDS = ["doi", "journal", "volume", "pages", "abstract"]
FILLERS = ["", "n/a", "unknown", "none", "-"]
CHUNK = 64
LAST = 2**31 - 1


def filled(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")).isin(FILLERS)


def source_key(c: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "[ -]", "_")


def instant(c: str) -> Column:
    """ISO text as microseconds; text without an offset is UTC; null if it is blank or names no day."""
    t = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"([+-]\d\d)(\d\d)$", "$1:$2")
    day, time, zone = r"^\d{4}-\d\d-\d\d", r"[T ]\d\d:\d\d(:\d\d([.,]\d+)?)?", r"\s?(Z|z|[+-]\d\d(:\d\d)?)"
    whole = F.when(t.rlike(f"{day}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(f"{day}{time}$"), F.concat(t, F.lit("Z"))).when(t.rlike(f"{day}{time}{zone}$"), F.upper(F.regexp_replace(t, r"([+-]\d\d)$", "$1:00")))
    # A bare day ends like an offset of hours, thus only texts with a time come here with one.
    return F.unix_micros(F.regexp_replace(whole, ",", ".").try_cast("timestamp"))


def score(c: str) -> Column:
    """Confidence in thousandths; above one it is a percentage; null and NaN give null."""
    x = F.when(F.col(c) > 1, F.col(c) / 100).otherwise(F.col(c))
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.round(x * 1000).cast("int"))


def groups(papers: DataFrame) -> DataFrame:
    key = F.lower("file_hash")
    return papers.where(F.col("file_hash").isNotNull() & (F.trim("file_hash") != "") & ~F.coalesce(F.col("file_size") == 0, F.lit(False))).withColumn("group_key", key)


def ranked(papers: DataFrame, trust: DataFrame) -> DataFrame:
    """Rows of groups with ``best``: the smaller, the better."""
    ranks = trust.groupBy(source_key("source").alias("trust_source")).agg(F.min("trust_rank").alias("trust_rank"))
    rows = groups(papers).withColumn("trust_source", source_key("source")).join(ranks, "trust_source", "left")
    best = F.struct(
        F.coalesce("trust_rank", F.lit(LAST)).alias("rank"),
        F.coalesce(-score("confidence"), F.lit(LAST)).alias("confidence"),
        F.coalesce(-instant("updated_at"), F.lit(2**62)).alias("updated"),
        F.col("id"),
    )
    return rows.withColumn("best", best)


def survivors(papers: DataFrame, trust: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """group_id, field, donor_id: for each group and filled field the row whose value survives."""
    rows = ranked(papers.select("id", "file_hash", "file_size", "source", "confidence", "updated_at", *fields), trust)
    one = rows.groupBy("group_key").agg(F.min("id").alias("group_id"), F.count("*").alias("n"), *(F.min(F.when(filled(f), F.col("best"))).alias(f) for f in fields)).where("n > 1")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f)["id"].alias("donor_id")) for f in fields))).alias("v")
    return one.select("group_id", each).where("v.donor_id is not null").select("group_id", "v.field", "v.donor_id")


Profile = list[dict[str, float]]  # a column: the weight of each token; "" is a gap
GAP, CELLS = -0.35, 4_000_000  # cells of the table in hand


def path(a: Profile, b: Profile, wa: float, wb: float) -> list[tuple[int, int]]:
    """Pairs of columns of the best global alignment, -1 for a gap; whole rows of the table are filled at once.

    Of a table over ``CELLS`` only every so many rows are kept; the rows between are filled again on the way back.
    """
    n, m = len(a), len(b)
    where: dict[str, list[tuple[int, float]]] = {}
    for j, c in enumerate(b):
        for t, w in c.items():
            if t:
                where.setdefault(t, []).append((j, w / wb))
    steps = np.arange(m + 1) * GAP

    def fill(first: np.ndarray, begin: int, end: int):
        """What each column of ``b`` matches, and the table, row by row from ``begin``, whose row is ``first``."""
        row = first
        for i in range(begin, end):
            match = np.full(m, -0.6)
            for t, w in a[i].items():
                for j, v in where.get(t, ()) if t else ():
                    match[j] += 2 * v * w / wa
            new = np.empty(m + 1)
            new[0] = row[0] + GAP
            new[1:] = np.maximum(row[:-1] + match, row[1:] + GAP)
            row = np.maximum.accumulate(new - steps) + steps  # gaps along the row
            yield match, row

    step = max(CELLS // (m + 1), math.isqrt(n), 1)
    kept = {0: steps}
    if n > step:
        for i, (_, row) in enumerate(fill(steps, 0, n - 1), 1):
            if i % step == 0:
                kept[i] = row
    out = []
    i, j = n, m
    for begin in sorted(kept, reverse=True):
        rows, matches = [kept[begin]], []
        for match, row in fill(kept[begin], begin, min(begin + step, n)):
            matches.append(match)
            rows.append(row)
        while i > begin or (j and not begin):
            here = rows[i - begin]
            if i and j and here[j] <= rows[i - 1 - begin][j - 1] + matches[i - 1 - begin][j - 1] + 1e-9:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif i and here[j] <= rows[i - 1 - begin][j] + GAP + 1e-9:
                i -= 1
                out.append((i, -1))
            else:
                j -= 1
                out.append((-1, j))
    return out[::-1]


def merge(a: Profile, b: Profile) -> Profile:
    """Global alignment of two profiles; equal tokens attract by their weights."""
    if not a or not b:
        return [*a, *b]
    wa, wb = sum(a[0].values()), sum(b[0].values())
    out: Profile = []
    for i, j in path(a, b, wa, wb):
        col = dict(a[i]) if i >= 0 else {"": wa}
        for t, w in (b[j] if j >= 0 else {"": wb}).items():
            col[t] = col.get(t, 0.0) + w
        out.append(col)
    return out


def vote(profile: Profile) -> list[str]:
    return [t for col in profile if (t := max(sorted(col), key=col.__getitem__))]


def _profile(pdf: pd.DataFrame) -> pd.DataFrame:
    """One profile from the values or profiles of a chunk, the heaviest first."""
    parts = []
    for value, weight, profile in zip(pdf["value"], pdf["weight"], pdf["profile"], strict=True):
        parts.append((weight, value or "", json.loads(profile) if profile else [{t: weight} for t in value.split()]))
    parts.sort(key=lambda p: (-p[0], p[1]))
    whole: Profile = parts[0][2]
    for _, _, p in parts[1:]:
        whole = merge(whole, p)
    first = pdf.iloc[0]
    out = {"group_id": [int(first["group_id"])], "field": [first["field"]], "value": [None], "weight": [float(pdf["weight"].sum())], "profile": [json.dumps(whole, sort_keys=True)], "voted": [" ".join(vote(whole))]}
    return pd.DataFrame(out)


def edits(x: list[str], y: list[str]) -> int:
    """Token edit distance; common ends are passed over, rows of the table filled at once."""
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    x, y = x[k:], y[k:]
    k = 0
    while k < min(len(x), len(y)) and x[-1 - k] == y[-1 - k]:
        k += 1
    x, y = x[: len(x) - k], y[: len(y) - k]
    if not x or not y:
        return len(x) + len(y)
    ids = {t: i for i, t in enumerate({*x, *y})}
    target, steps = np.array([ids[t] for t in y]), np.arange(len(y) + 1)
    row = steps.copy()
    for i, t in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (target != ids[t]), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def distance(value: pd.Series, voted: pd.Series) -> pd.Series:
    """Token edit distance of a value to what its group voted for."""
    return pd.Series([float(edits(v.split(), y.split())) for v, y in zip(value, voted, strict=True)])


def consensus(papers: DataFrame, trust: DataFrame, fields: list[str]) -> DataFrame:
    """group_id, field, donor_id, value: for each field the value closest to what the values of its group agree on."""
    rows = ranked(papers.select("id", "file_hash", "file_size", "source", "confidence", "updated_at", *fields), trust)
    ids = rows.groupBy("group_key").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    weight = F.sum(1.0 / (1.0 + F.least(F.col("best.rank"), F.lit(20))))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(filled(f), F.trim(F.regexp_replace(f, r"\s+", " "))).alias("value")) for f in fields))).alias("v")
    values = rows.select("group_key", "id", "best", each).where("v.value is not null").groupBy("group_key", "v.field", "v.value").agg(weight.alias("weight"), F.min("id").alias("donor_id"))
    values = values.join(ids.hint("merge"), "group_key").drop("group_key")
    key = ["group_id", "field"]
    counted = cut(values.join(values.groupBy(*key).agg(F.count("*").alias("values")).hint("merge"), key))
    alone = counted.where("values = 1").select(*key, "donor_id", "value")  # agrees with itself
    values = counted.where("values > 1").drop("values")
    state = values.select(*key, "value", "weight", F.lit(None).cast("string").alias("profile"))
    while True:
        sizes = state.groupBy(*key).agg(F.count("*").alias("n"))
        state = state.join(sizes.hint("merge"), key).withColumn("chunk", F.pmod(F.xxhash64("value", "profile"), F.ceil(F.col("n") / CHUNK)))
        state = cut(state.groupBy(*key, "chunk").applyInPandas(_profile, "group_id long, field string, value string, weight double, profile string, voted string"))
        if state.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        state = state.drop("voted")
    near = values.join(state.select(*key, "voted").hint("merge"), key).withColumn("distance", distance("value", "voted"))
    order = F.struct("distance", -F.col("weight"), "donor_id")
    return near.groupBy(*key).agg(F.min_by(F.struct("donor_id", "value"), order).alias("v")).select(*key, "v.donor_id", "v.value").unionByName(alone)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "papers"), table(spark, sf_dir, "source_trust"))


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "papers"), table(spark, sf_dir, "source_trust"), ["title", *FIELDS])


QUERIES = {"p2_found": p2_found, "p2_consensus": p2_consensus}

SQL = {
    "p2_found": """
with g as (
  select id, lower(file_hash) k, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) s, confidence c, trim(updated_at) u, doi, journal, volume, pages, abstract
  from papers where file_hash is not null and trim(file_hash) <> '' and coalesce(file_size, 1) <> 0
), r as (
  select g.id, k, coalesce(t.trust_rank, 2147483647) rk,
    case when c is null or isnan(c) then -1e9 else round(case when c > 1 then c / 100 else c end * 1000) end cf,
    case when u is null or u = '' then timestamptz '0001-01-01 00:00:00+00' when regexp_matches(u, '(Z|[+-]\\d\\d:\\d\\d)$') then cast(u as timestamptz) else cast(u || '+00' as timestamptz) end up,
    min(g.id) over (partition by k) group_id, count(*) over (partition by k) n, doi, journal, volume, pages, abstract
  from g left join source_trust t on t.source = replace(replace(s, ' ', '_'), '-', '_')
), f as (
  select group_id, id, rk, cf, up, unnest(['doi', 'journal', 'volume', 'pages', 'abstract']) field, unnest([doi, journal, volume, pages, abstract]) v from r where n > 1
)
select group_id, field, id donor_id from f
where v is not null and lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g')) not in ('', 'n/a', 'unknown', 'none', '-')
qualify row_number() over (partition by group_id, field order by rk, cf desc, up desc, id) = 1
"""
}
