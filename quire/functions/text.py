"""Column functions on text: normal forms, cleaning, tokens, extraction.

Patterns use Unicode classes spelled out, so they mean the same in every engine.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dashes, quotes, controls without width.
DASHES = "‐‑‒–—―−"
DASH = "[‐‑‒–—―−]"
SINGLE_QUOTES, DOUBLE_QUOTES = "[‘’‚‛]", "[“”„‟]"
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff\u00ad]"
BIDI = "[\u200e\u200f\u202a-\u202e\u2066-\u2069]"
WORD = r"[\p{L}\p{N}_]+"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x: str | Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c(x), pattern, to)


def spaces(x: str | Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(sub(x, r"\s+", " "))


def comparison_form(x: str | Column) -> Column:
    """Spacing made even around commas and hyphens."""
    return spaces(sub(sub(x, r"\s*,\s*", ", "), r"\s*-\s*", "-"))


def scoring_form(x: str | Column) -> Column:
    """Comparison form in lower case without punctuation."""
    return spaces(sub(F.lower(comparison_form(x)), r"[^\p{L}\p{N}_\s]", ""))


def ascii_form(x: str | Column) -> Column:
    return spaces(sub(F.lower(c(x)), r"[^a-z0-9 ]", ""))


def edge_form(x: str | Column) -> Column:
    """Lower case, even spacing, no punctuation at the ends."""
    return sub(spaces(F.lower(c(x))), r"^[.,;:!?'\"()\[\]{}-]+|[.,;:!?'\"()\[\]{}-]+$", "")


def author_form(x: str | Column) -> Column:
    return sub(edge_form(x), r"^(dr|prof|professor)\.?\s+", "")


def plain_latex(x: str | Column) -> Column:
    """Formulas dropped, commands unwrapped, braces removed."""
    y = sub(x, r"\$[^$]*\$", " ")
    y = sub(y, r"\\[A-Za-z]+\{([^{}]*)\}", "$1")
    return spaces(sub(sub(y, r"\\[A-Za-z]+", " "), r"[{}]", ""))


def even_marks(x: str | Column) -> Column:
    """Plain dashes and quotes."""
    return sub(sub(sub(x, DASH, "-"), SINGLE_QUOTES, "'"), DOUBLE_QUOTES, '"')


def without_hidden(x: str | Column) -> Column:
    return sub(sub(x, ZERO_WIDTH, ""), BIDI, "")


def title_form(x: str | Column) -> Column:
    """Formulas and punctuation gone, lower case: titles under it are compared."""
    return spaces(sub(F.lower(even_marks(plain_latex(x))), r"[^\p{L}\p{N}\s]", " "))


def stem_form(x: str | Column) -> Column:
    """The name of a file without folder and ending, with plain dashes, in lower case."""
    return spaces(F.lower(sub(sub(sub(x, r"^.*/", ""), r"\.[A-Za-z0-9]{1,4}$", ""), DASH, "-")))


def safe_name(x: str | Column) -> Column:
    """Characters that file systems reserve as underscores; no dots at the ends; never empty."""
    y = sub(sub(x, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(y == "", F.lit("unnamed")).otherwise(y)


def clean(x: str | Column) -> Column:
    """Tags, links, mail addresses, citations and hidden characters out; even marks and spaces."""
    y = sub(x, r"<[^<>]+>", " ")
    y = sub(sub(y, r"https?://\S+", " "), r"[\w.+-]+@[\w-]+\.[\w.]+", " ")
    y = sub(y, r"\[\d+(,\s*\d+)*\]", " ")
    return spaces(even_marks(without_hidden(y)))


def sentences(x: str | Column, least: int = 6) -> Column:
    return F.filter(F.transform(F.split(c(x), r"[.!?]+\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def words(x: str | Column, least: int = 1) -> Column:
    found = F.regexp_extract_all(F.lower(c(x)), F.lit(WORD), 0)
    return found if least <= 1 else F.filter(found, lambda w: F.length(w) >= least)


def ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, n)))).otherwise(F.array().cast("array<string>"))


def doi(x: str | Column) -> Column:
    """A bare identifier in lower case, or null."""
    y = F.lower(F.regexp_extract(c(x), r"(10\.\d{4,9}/[^\s\"<>]+)", 1))
    y = sub(y, r"[.,;)]+$", "")
    return F.when(y != "", y)


def arxiv(x: str | Column) -> Column:
    """struct(id, version) of an identifier in new or old form."""
    y = F.regexp_extract(c(x), r"(\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v(\d+))?", 1)
    v = F.regexp_extract(c(x), r"(\d{4}\.\d{4,5}|[a-z-]+/\d{7})v(\d+)", 2)
    return F.struct(F.when(y != "", y).alias("base"), F.when(v != "", v.cast("int")).alias("version"))


def year(x: str | Column) -> Column:
    y = F.regexp_extract(c(x), r"(1[89]\d\d|20\d\d)", 1)
    return F.when(y != "", y.cast("int"))


def author_list(x: str | Column) -> Column:
    return F.from_json(c(x), "array<string>")


def family(x: Column) -> Column:
    """Family name of "Family, Given" or "Given Family"."""
    return F.when(F.contains(x, F.lit(",")), F.trim(F.split_part(x, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(F.trim(x), r"(\S+)$", 1))


def _folded(text: str | None) -> str | None:
    if text is None:
        return None
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(ch)).lower()


@F.pandas_udf(T.StringType())
def folded(x: pd.Series) -> pd.Series:
    """Lower case without accents (the engine has no Unicode normaliser of its own)."""
    return x.map(_folded, na_action="ignore")


@F.pandas_udf(T.StringType())
def composed(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")
