"""Personal information inside free text (problem 10).

Addresses of mail, phone numbers, identity numbers, street addresses and names are found by
patterns and checks (the more specific kinds first; what one kind takes, no other takes): account and
card numbers by their check digits, names by given name or initial, and, whatever the script and
whether the name is in any list, where a title, a salutation or a label stands before two words in
capitals, or where the second of two Russian words ends like a family name. Each distinct value
becomes a typed placeholder, numbered in its document, so the same value is the same placeholder.
The surrogate form puts a keyed, format-preserving replacement in its place: given names become
names of the same gender, other letters and digits become letters and digits of the same kind, case
and script. Replacements are the same for the same value everywhere (coreference), and values that
would collide are drawn again until all are distinct.

Defined cases: null text stays null and holds nothing; empty text stays empty; texts are read
whole; repeated rows are treated alike; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table

# Given names in frequent use in the languages of the texts, by gender.
FEMALE = (
    "Alice Amélie Ana Anja Anna Anne Anne-Lise Anneliese Barbara Beatrice Birgit Camille Carla Caroline Catherine Charlotte Chiara Claire Clara Claudia "
    "Cornelia Daniela Denise Diana Elena Elisabeth Elise Elizabeth Emily Emma Eva Fiona Florence Franziska Françoise Gabriela Gabriele Gisela Hannah Heidi "
    "Helen Helena Helga Hélène Ingrid Irene Isabel Isabelle Jana Jane Janet Jennifer Josephine Julia Juliane Karin Katharina Katherine Laura Lena Lisa Louise "
    "Lucia Lucie Magdalena Margaret Margareta Margarethe Maria Marie Marion Marta Martha Mathilde Mia Monika Nadine Nicole Nina Nora Olga Patricia Paula Petra Pilar Rebecca "
    "Renate Rosa Rosalind Ruth Sabine Sandra Sara Sarah Silvia Sofia Sophie Susan Susanna Susanne Sylvie Theodora Theresa Ulrika Ulrike Ursula Valentina Vera Veronika Victoria Vivienne Xenia Yvonne Zoe Zuzana"
).split()
MALE = (
    "Adam Alan Albert Alessandro Alexander Andreas Andrew Anthony Antoine Anton Arthur Benedikt Benjamin Bernard Bernd Bruno Carl Carlos Charles Christian Christoph "
    "Christopher Claude Daniel Daniele David Dieter Dominik Edward Emil Eric Erik Ernst Felix Ferdinand Francesco Frank Franz Frederic Frederik Friedrich Georg "
    "George Gerard Gerhard Giovanni Guillaume Gustav Hans Heinrich Henri Henry Hugo Ivan Jack Jacob Jakob James Jan Jean Jens Joachim Johann Johannes John Jonas "
    "Josef Joseph Juan Jürgen Karl Kevin Klaus Konrad Lars Laurent Leo Leonard Leonhard Louis Luca Lukas Manuel Marc Marco Mark Martin Matthew Matthias Max "
    "Maximilian Michael Michel Miguel Nicolas Niels Nikolaus Olivier Ondřej Oscar Otto Patrick Paul Pedro Peter Philip Philipp Pierre Rafael Ralf Richard Robert Roger Roland Rolf "
    "Samuel Sebastian Simon Stefan Stephan Stephen Steven Sven Thomas Theo Tim Tobias Ulrich Valentin Victor Vincent Walter Werner William Wolfgang Yusuf Yves Édouard"
).split()
# Words of street names, of family names, titles, and words that open sentences.
STREET = "Road|Street|Avenue|Lane|Court|Square|Drive|Place|Way|Close|Terrace|Crescent|Gardens|Hill|Row|Walk|Mews|Boulevard|Parade|Quay"
PARTICLE = r"(?:(?:van|von|de|der|den|zu|di|du|da|del|la|le|ten|ter|dos|al|el)\s+){0,3}"
OPENERS = {"The", "In", "We", "A", "An", "For", "This", "These", "It", "At", "By", "On", "Our", "Its", "If", "As", "To", "Moreover", "Both", "Under", "Consequently", "Numerical", "Examples", "Several", "Section", "Equation", "Recall", "Grant", "Call", "Many", "Please", "Copies", "Contact", "Version", "Exercise", "Motivated", "Proposition", "Passport", "Correspondence", "Let", "See", "Explain", "State", "Suppose", "Among", "Given", "Decide", "Name", "Show", "Find", "Prove", "Which", "What", "How", "Why", "When", "Where", "Does", "Is", "Are", "Can", "No", "There", "That", "With", "From", "Until", "Since", "Using", "Write", "Answer", "Question", "And", "But", "Or", "Then", "Thus", "Hence", "So", "Die", "Der", "Das", "Wir", "Le", "Les", "La", "Nous", "Pour"}
KINDS = ["email", "address", "id_number", "phone", "name"]

L = r"[^\W\d_]"
UP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ]"
CAP = rf"{UP}{L}*(?:[’'-]{L}+)*"
TOWN = rf"(?:(?:Saint|Sainte|St\.|Bad|New|Upper|Lower|Great|Little|North|South|East|West)[ -])?{UP}{L}+(?:-{L}+)*"
AT = r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?)"
DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
EMAIL = re.compile(
    rf"[\w][\w.+%-]*{AT}[^\W_][\w-]*(?:{DOT}[^\W_][\w-]*)*{DOT}[^\W\d_]{{2,}}(?![\w@])"
    rf"|\b[\w][\w.+%-]*\sat\s[^\W_][\w-]*(?:\sdot\s[\w-]+)+",
    re.IGNORECASE,
)
AT_ALL = re.compile(r"[\[({]\s?[aA][tT]\s?[\])}]|\s[aA][tT]\s[^\W_][\w-]*\s[dD][oO][tT]\s")  # every mail address but those with the sign itself has one
POSTCODE = r"(?:,?\s(?:\d{5}\b|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b))?"
ADDRESS = re.compile(
    rf"(?:\b(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\d+[A-Za-z]?,\s)?\b\d{{1,4}}[A-Za-z]?\s(?:{CAP}\s){{1,3}}(?:{STREET}),\s{TOWN}{POSTCODE}"
    rf"|\b\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse)\s(?:(?:des|de|du|de\sla|d’|d'|la|le|les)\s?)*{CAP}(?:[\s-]{CAP})*,\s\d{{5}}\s{TOWN}"
)
# These begin with a word, so they are looked for only where their numbers stand.
BEHIND = re.compile(rf"\b(?:(?:Am|An\sder|Auf\sder|Im|Zum|Zur)\s{CAP}|{UP}{L}*(?:straße|strasse|weg|allee|gasse|platz|ring|damm|ufer|hof))\s\d{{1,4}}[a-z]?,\s\d{{5}}\s{TOWN}")
BEHIND_ALL = re.compile(r"\s\d{1,4}[a-z]?,\s\d{5}\s")
ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.+-])[2-6](?:[ -]?\d){12,18}(?![\w-])")
ID = re.compile(
    r"(?<![\w.+-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?!\w)|[A-Z]\d{7}(?!\w)|\d{9}(?![\w-])|\d{6}[-+]\d{4}(?!\w)|\d{3}\.\d{3}\.\d{3}-\d{2}(?!\w)|\d{3}-\d{2}-\d{4}(?!\w))"
)
PHONE = re.compile(
    r"(?<![\w.@:/-])(?<!ISSN\s)(?<!ISBN\s)(?<!Grant\s)(?<!MSC\s)(?:"
    r"(?:\+|00)\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{2,5}|[ .-]\d{1,5})(?:[ .-]?\d{2,6}){1,5}"
    r"|\(\d{3,5}\)\s?\d{3,4}[ .-]?\d{3,4}|\d{3}[-.\s]\d{3}[-.\s]\d{4}|0\d{2,4}[\s/-]\d{5,8}|\d{3}-\d{4}"
    r")(?:\s*(?:ext\.?|extension|x|Durchwahl|Dw\.|poste)\s*\d{1,5})?(?![\w-])"
)
GIVEN = {*FEMALE, *MALE}
INITIAL = rf"{UP}\.(?:\s?-?\s?{UP}\.)*"
ONE = rf"{UP}{L}+(?:-{UP}{L}+)?"
NAME = re.compile(
    rf"(?<![\w.’'-])(?:(?P<g>{ONE})(?:\s{INITIAL})?\s{PARTICLE}(?P<a>{ONE})|{INITIAL}\s?{PARTICLE}(?P<b>{ONE})"
    rf"|{PARTICLE}(?P<c>{ONE}),\s(?:(?P<h>{ONE})(?:\s{INITIAL})?(?!{L})|{INITIAL}(?!\s?{UP}{L})))"
)
# What stands before a name.
CUE = re.compile(
    r"(?:\b(?:Dr|Prof|Professor|Mr|Mrs|Ms|Sir|Herr|Frau|Mme|Monsieur|Madame|Dear|Liebe|Lieber|Cher|Chère|Sehr\sgeehrter\sHerr|Sehr\sgeehrte\sFrau|г-н|г-жа|проф)\b\.?\s+"
    r"|\b(?:[Nn]ame|[Cc]ontact|[Cc]ontact\sperson|[Ss]igned|[Aa]pplicant|[Pp]atient|[Cc]lient|[Ee]mployee|[Kk]ontakt|[Uu]nterzeichnet|[Nn]om|[Ss]igné|имя)\s?:\s*)"
    r"(?=[^\W\d_])"
)
CALLED = re.compile(rf"(?P<g>[^\W\d_]+(?:[-’'][^\W\d_]+)*)(?:\s{INITIAL})?\s{PARTICLE}(?P<a>[^\W\d_]+(?:[-’'][^\W\d_]+)*)")
RUSSIAN = re.compile(r"(?<![\w-])[А-ЯЁ][а-яё]+\s(?:[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна)\s)?[А-ЯЁ][а-яё]+(?:ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына|ский|ская|цкий|цкая|енко)(?!\w)")
# Terms of the trade are named after people; they are no persons here.
TERM = re.compile(r"^(?:[’']s)?\s(?:inequality|theorem|lemma|condition|conjecture|equation|formula|transform|operator|measure|space|algebra|estimate|kernel|functional|bound)s?\b")


def account(value: str) -> bool:
    """An international account number: 1 by the remainder of 97."""
    v = re.sub(r"\s", "", value)
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def card(value: str) -> bool:
    """A card number: its doubled digits add up to tens."""
    d = [int(c) for c in value if c.isdigit()]
    return len(set(d)) > 1 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def names(text: str):
    """Spans of names."""
    at = 0
    while m := NAME.search(text, at):
        a, b = m.span()
        given = m["g"] or m["h"]
        if given and given not in GIVEN:
            at = a + re.match(r"\S+?(?=[\s,])", text[a:]).end()
            continue
        family = m["a"] or m["b"] or m["c"]
        at = b
        if family.capitalize() in OPENERS or (m["b"] and family.isupper()) or (text[max(0, a - 4) : a].lower().endswith("the ") and TERM.match(text[b : b + 40])):
            continue
        yield a, b
    for cue in CUE.finditer(text):
        m = CALLED.match(text, cue.end())
        if m and all(m[k][0].isupper() and not m[k].isupper() and m[k] not in OPENERS for k in "ga") and m["g"] not in TITLES and not TERM.match(text[m.end() : m.end() + 40]):
            yield m.span()
    if any("А" <= c <= "я" for c in text):
        yield from (m.span() for m in RUSSIAN.finditer(text))


# Titles that may follow one another.
TITLES = {"Dr", "Prof", "Professor", "Mr", "Mrs", "Ms", "Sir", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Sirs", "All", "Colleagues", "Colleague", "Madam"}


def spans(kind: str, text: str):
    if kind == "email":
        if "@" in text or AT_ALL.search(text):
            yield from (m.span() for m in EMAIL.finditer(text))
    elif kind == "address":
        yield from (m.span() for m in ADDRESS.finditer(text))
        if BEHIND_ALL.search(text):
            yield from (m.span() for m in BEHIND.finditer(text))
    elif kind == "id_number":
        yield from (m.span() for m in ACCOUNT.finditer(text) if account(m[0]))
        yield from (m.span() for m in CARD.finditer(text) if card(m[0]))
        yield from (m.span() for m in ID.finditer(text))
    elif kind == "phone":
        yield from (m.span() for m in PHONE.finditer(text))
    else:
        yield from names(text)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of each finding, without overlaps, in order."""
    if not text:
        return []
    taken: list[tuple[str, int, int]] = []
    begins: list[int] = []
    for kind in KINDS:
        for a, b in spans(kind, text):
            k = bisect_left(begins, b)
            if k and taken[k - 1][2] > a:  # the last that begins before its end
                continue
            begins.insert(k, a)
            taken.insert(k, (kind, a, b))
    return taken


FOUND = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("pii_value", T.StringType()), T.StructField("at", T.IntegerType())]))


@F.pandas_udf(FOUND)
def findings(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"pii_type": k, "pii_value": t[a:b], "at": a} for k, a, b in find(t)] for t in texts])


@F.pandas_udf(T.StringType())
def placeholders(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        numbers: dict[tuple[str, str], int] = {}
        of_kind: dict[str, int] = {}
        parts, at = [], 0
        for kind, a, b in find(t):
            value = (kind, t[a:b])
            if value not in numbers:
                of_kind[kind] = numbers[value] = of_kind.get(kind, 0) + 1
            parts += [t[at:a], f"[{kind.upper()}_{numbers[value]}]"]
            at = b
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out, dtype=object)


def stream(key: bytes, *what: str):
    """Endless keyed bytes for a value."""
    n = 0
    while True:
        yield from hmac.new(key, "\x1f".join([*what, str(n)]).encode(), hashlib.sha256).digest()
        n += 1


VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"
LONGER = 5  # turns after which a surrogate is longer by one character
KEY = os.environ.get("QUIRE_SURROGATE_KEY", "quire")  # set your own: who knows the key can repeat the replacements


def disguise(kind: str, word: str, key: bytes, turn: int) -> str:
    """Letters to letters, digits to digits; case, script and marks between stay."""
    draw = stream(key, kind, word.casefold(), str(turn))
    out = []
    for ch in word:
        k = next(draw)
        if ch.isdigit():
            out.append(str(k % 10))
        elif "a" <= ch.lower() <= "z" or "À" <= ch <= "ž":
            base = VOWELS if ch.lower() in "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüā" else CONSONANTS
            new = base[k % len(base)]
            out.append(new.upper() if ch.isupper() else new)
        elif "а" <= ch.lower() <= "я":
            new = "аеиоубвгдзклмнпрст"[k % 18]
            out.append(new.upper() if ch.isupper() else new)
        else:
            out.append(ch)
    # What still collides after some turns grows by a letter or digit, so there is room for all.
    for _ in range(turn // LONGER if out else 0):
        k = next(draw)
        out.append(str(k % 10) if out[-1].isdigit() else (VOWELS + CONSONANTS)[k % 23])
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, turn: int) -> str:
    """A replacement of the same kind and format; each part of a name by itself, so all forms of it agree."""
    if kind == "name":
        parts = re.split(r"([\s,]+)", value)
        out = []
        for p in parts:
            pool = FEMALE if p in FEMALE else MALE if p in MALE else None
            if pool:  # same gender, and a first letter that an initial would get too
                first = disguise("initial", p[0], key, turn)[:1].upper()
                own = [x for x in pool if x[0] == first] or pool
                out.append(own[next(stream(key, "given", p, str(turn))) % len(own)])
            elif re.fullmatch(rf"(?:-?{UP}\.)+", p):
                out.append("".join(disguise("initial", c, key, turn) if c.isalpha() else c for c in p))
            elif p[:1].isupper():
                out.append(disguise("family", p, key, turn))
            else:
                out.append(p)
        return "".join(out)
    if kind == "email":
        local = re.split(rf"({AT}|\sat\s)", value, maxsplit=1, flags=re.IGNORECASE)
        return disguise(kind, local[0], key, turn) + "".join(local[1:])
    if kind == "phone":
        keep = re.match(r"(?:\+|00)\d{1,3}|0(?=\d)|", value).end()
        return value[:keep] + disguise(kind, value[keep:].split("x")[0], key, turn) + value[keep:][len(value[keep:].split("x")[0]) :] if "ext" not in value else value[:keep] + disguise(kind, re.split(r"\s*ext", value[keep:])[0], key, turn) + value[keep + len(re.split(r"\s*ext", value[keep:])[0]) :]
    if kind == "address":
        words = re.split(r"([\s,]+)", value)
        fixed = {*STREET.split("|"), "Flat", "Apt", "Unit", "Suite", "Am", "An", "Im", "rue", "des", "de", "du", "la", "le", "les", "der", "Markt"}
        return "".join(w if w in fixed or not w.strip(" ,") else disguise(kind, w, key, turn) for w in words)
    return disguise(kind, value, key, turn)


def pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every distinct value found in a document: key, pii_type, pii_value."""
    one = df.select(F.col(key).alias(key), F.explode(findings(F.col(text))).alias("f"))
    return one.select(key, "f.pii_type", "f.pii_value").distinct()


def surrogates(found: DataFrame, key: str = KEY, most_turns: int = 60) -> DataFrame:
    """A distinct surrogate for each distinct value; those that collide are drawn again, and none is returned twice."""
    secret = key.encode()

    @F.pandas_udf(T.StringType())
    def made(kinds: pd.Series, values: pd.Series, turns: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, secret, n) for k, v, n in zip(kinds, values, turns, strict=True)], dtype=object)

    values = found.select("pii_type", "pii_value").distinct().withColumn("turn", F.lit(0))
    for turn in range(most_turns):
        values = cut(values.select("pii_type", "pii_value", "turn", made("pii_type", "pii_value", "turn").alias("surrogate")))
        first = values.groupBy("pii_type", "surrogate").agg(F.min(F.struct("turn", "pii_value"))["pii_value"].alias("keeps"))
        values = values.join(first.hint("merge"), ["pii_type", "surrogate"]).withColumn("again", F.col("keeps") != F.col("pii_value")).drop("keeps")
        if values.where("again").isEmpty():
            return values.select("pii_type", "pii_value", "surrogate")
        values = values.withColumn("turn", F.when(F.col("again"), F.lit(turn + 1)).otherwise(F.col("turn")))
    raise ValueError(f"surrogates still collide after {most_turns} turns")


@F.pandas_udf(T.StringType())
def spliced(texts: pd.Series, parts: pd.Series) -> pd.Series:
    """Texts with the given parts (at, value, surrogate) replaced."""
    out = []
    for text, ps in zip(texts, parts, strict=True):
        if ps is not None and text is not None:
            done, at = [], 0
            for p in sorted(ps, key=lambda p: p["at"]):
                done += [text[at : p["at"]], p["surrogate"]]
                at = p["at"] + len(p["pii_value"])
            text = "".join([*done, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def pseudonymised(df: DataFrame, key: str = "doc_id", text: str = "text", secret: str = KEY) -> DataFrame:
    """``df`` with every finding in ``text`` replaced by its surrogate; the same value is the same surrogate in all texts."""
    rows = cut(df.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("t")).where("t is not null").select("row", "t", findings("t").alias("f")).where(F.size("f") > 0).distinct())
    each = rows.select("row", F.explode("f").alias("f")).select("row", "f.*")
    made = each.join(surrogates(each, secret).hint("merge"), ["pii_type", "pii_value"])
    parts = made.groupBy("row").agg(F.collect_list(F.struct("at", "pii_value", "surrogate")).alias("parts"))  # of one text
    return df.withColumn("row_", F.xxhash64(key, text)).join(parts.withColumnRenamed("row", "row_").hint("merge"), "row_", "left").withColumn(text, spliced(F.col(text), F.col("parts"))).drop("row_", "parts")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", placeholders("text").alias("text"))


def p10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(p10_found(spark, sf_dir))


def p10_pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p10_pseudonymised": p10_pseudonymised, "p10_found": p10_found, "p10_redacted": p10_redacted, "p10_surrogates": p10_surrogates}
