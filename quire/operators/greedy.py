"""Operators in which the order of rows decides: first wins, lines from words, replay of tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import indel


def first_wins(df: DataFrame, key: str, text: str, block: int = 20, least: float = 0.95) -> DataFrame:
    """Keep a row unless an earlier kept one of its block is nearly the same (first ``block`` characters without spaces).

    Equal texts are one row before. A block is read in order and only its kept texts are held; the block of
    texts without any characters is left out.
    """
    one = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias(key))
    b = F.substring(F.regexp_replace(F.lower(text), r"\s", ""), 1, block)
    one = one.select(key, text, b.alias("block")).where("block <> ''")
    schema = ", ".join(f"{n} {t}" for n, t in one.select(key, text).dtypes)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        rows = []
        for k, t in pdf.sort_values(key)[[key, text]].itertuples(index=False):
            if not any(2 * min(len(t), len(o)) >= least * (len(t) + len(o)) and indel(t, o) >= least for o in kept):
                kept.append(t)
                rows.append((k, t))
        return pd.DataFrame(rows, columns=[key, text])

    return one.groupBy("block").applyInPandas(keep, schema)


def lines_of_words(df: DataFrame, page: str, gap: float = 3.0) -> DataFrame:
    """Words (x, y, text, size) of each page as lines: a word belongs to a line if its y is within ``gap`` of the line's first."""
    schema = f"{page} {dict(df.dtypes)[page]}, line int, text string, x0 double, y0 double, size double"

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        rows, line, anchor = [], -1, None
        for x, y, text, size in pdf[["x", "y", "text", "size"]].itertuples(index=False):
            if anchor is None or abs(y - anchor) > gap:
                line, anchor = line + 1, y
            rows.append((line, x, y, text, size))
        w = pd.DataFrame(rows, columns=["line", "x", "y", "text", "size"]).sort_values(["line", "x"])
        out = w.groupby("line").agg(text=("text", " ".join), x0=("x", "min"), y0=("y", "min")).reset_index()
        longest = w.loc[w.assign(n=w["text"].str.len()).groupby("line")["n"].idxmax()].set_index("line")["size"]
        out["size"] = out["line"].map(longest)
        out.insert(0, page, pdf[page].iloc[0])
        return out[[page, "line", "text", "x0", "y0", "size"]].astype({"line": "int32"})

    return df.groupBy(page).applyInPandas(group, schema)


def replay(events: DataFrame, task: str, time: str, outcome: str, most: int = 3) -> DataFrame:
    """State of each task after its attempts: done, waiting (with seconds to wait: 2 to the attempts) or failed."""
    g = events.groupBy(task).agg(F.count("*").alias("attempts"), F.max_by(outcome, time).alias("last"))
    state = F.when(F.col("last") == "ok", "done").when(F.col("attempts") >= most, "failed").otherwise("waiting")
    return g.select(task, "attempts", state.alias("state"), F.when(state == "waiting", F.pow(F.lit(2), F.col("attempts")).cast("long")).alias("wait"))
