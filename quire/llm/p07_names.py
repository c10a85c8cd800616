"""Variant spellings of names typed by people (problem 7).

Every distinct spelling is rewritten to its canonical forms: titles are dropped, tokens put in order
(family name first, last, or behind its particle), nicknames become the given names they stand for,
given names become initials, the legal forms and prepositions of organisations are spelled out or
dropped. Spellings that share a form are joined by equality of forms, never by comparing all pairs.
Slips of the hand are rewritings too: each form with one character left out, so two forms within
one insertion, deletion, substitution or exchange meet and are then checked exactly. A rewriting is
worth more the rarer it is: an initial counts only where it leads to a single person of that family
name; a slip leads to the most frequent form, which must be at least ``TIMES`` as frequent or have a
name that others bear while the slip's has none, and the rarer it is beside it, the surer it is. Names with different middle initials are different persons,
and one without is then linked to neither.

Defined cases: null, empty or malformed author lists have no names; blank names are left out;
a name of any length is read whole; repeated rows count towards frequency only; ties of frequency
go to the smaller form by code point; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table

# Nicknames and the given names they stand for.
NICKNAMES = {
    "alex": "alexander", "sascha": "alexander", "sandy": "alexander", "al": "alexander", "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert",
    "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william", "ben": "benjamin", "benny": "benjamin", "chris": "christopher", "kit": "christopher",
    "dani": "daniele", "dan": "daniel", "danny": "daniel", "dora": "theodora", "thea": "theodora", "theo": "theodora", "edo": "edouard", "ed": "edouard", "eddie": "edouard",
    "ella": "elisabeth", "elsa": "elisabeth", "lisa": "elisabeth", "liz": "elisabeth", "lisbeth": "elisabeth", "beth": "elisabeth", "betty": "elisabeth", "sisi": "elisabeth",
    "fred": "frederik", "freddy": "frederik", "fritz": "frederik", "rik": "frederik", "gabi": "gabriela", "gaby": "gabriela", "gabe": "gabriel", "greta": "margareta", "gretel": "margareta",
    "margit": "margareta", "rita": "margareta", "meg": "margaret", "peggy": "margaret", "maggie": "margaret", "lena": "helene", "leni": "helene", "nell": "helene", "inga": "ingrid", "inge": "ingrid",
    "josie": "josephine", "jo": "josephine", "fina": "josephine", "katja": "katharina", "kathi": "katharina", "kate": "katharina", "kati": "katharina", "katie": "katharina", "kathy": "katharina",
    "klaus": "nikolaus", "niko": "nikolaus", "nick": "nikolaus", "nik": "nikolaus", "leo": "leonard", "len": "leonard", "lenny": "leonard", "matt": "matthias", "matze": "matthias", "hias": "matthias",
    "ondra": "ondrej", "piluca": "pilar", "pili": "pilar", "roz": "rosalind", "ros": "rosalind", "rosie": "rosalind", "rosa": "rosalind", "sanna": "susanna", "susi": "susanna", "sue": "susanna", "suse": "susanna",
    "tobi": "tobias", "toby": "tobias", "ulli": "ulrika", "uli": "ulrika", "rike": "ulrika", "viv": "vivienne", "vivi": "vivienne", "xeni": "xenia", "xena": "xenia", "yus": "yusuf", "jusuf": "yusuf",
    "zuza": "zuzana", "zuzka": "zuzana", "zuzi": "zuzana", "anneli": "anne-lise", "annelise": "anne-lise", "anni": "anne-lise", "jim": "james", "jack": "john", "johnny": "john", "mike": "michael", "mick": "michael",
    "tom": "thomas", "tommy": "thomas", "tony": "anthony", "joe": "joseph", "sepp": "josef", "dick": "richard", "rick": "richard", "steve": "stephen", "andy": "andrew", "sam": "samuel", "max": "maximilian", "hans": "johannes", "sepi": "josef",
}
# Titles, particles, and what organisations call themselves with their short forms.
TITLES = {"prof", "professor", "dr", "mr", "mrs", "ms", "sir", "phd", "dipl", "ing", "med", "rer", "nat"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv"}
PARTICLES = {"van", "von", "de", "la", "der", "den", "zu", "di", "du", "da", "del", "le", "ten", "ter", "dos"}
LEGAL = {
    "collaboration": "collaboration", "collab": "collaboration", "group": "group", "grp": "group", "working": "working", "wg": "working group", "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory",
    "institute": "institute", "inst": "institute", "institut": "institute", "consortium": "consortium", "project": "project", "proj": "project", "network": "network", "netw": "network", "team": "team",
    "university": "university", "univ": "university", "centre": "centre", "center": "centre", "ctr": "centre", "society": "society", "department": "department", "dept": "department", "company": "company",
    "inc": "company", "ltd": "company", "gmbh": "company", "foundation": "foundation", "academy": "academy", "acad": "academy", "school": "school", "association": "association", "assoc": "association",
}
HEADS = {"collaboration", "group", "working group", "laboratory", "institute", "consortium", "project", "network", "team", "university", "centre", "society", "department", "foundation", "academy", "school", "association"}
DROPPED = {"the", "for", "of", "on", "in", "and", "&", "at", "a", "an"}
SHORT = 4  # letters that an abbreviated word of an organisation's theme keeps
TIMES = 2  # a form is so many times as frequent as a slip of it
SLIP = 0.1  # a given name with a smaller share of the rows of one a slip away is a slip


class Plain(dict):
    """Code points in lower case to characters without accents, each worked out once."""

    def __missing__(self, c: int) -> str:
        self[c] = x = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x) and unicodedata.category(x) != "Cf")
        return x


PLAIN = Plain({ord(c): x for c, x in (("ß", "ss"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("æ", "ae"), ("œ", "oe"), ("ı", "i"))})


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.lower() if text.isascii() else text.lower().translate(PLAIN)


def organisation(name: str) -> tuple[str, str] | None:
    """(theme, family) of an organisation, or None."""
    words = re.findall(r"[^\s,;()]+", fold(name))
    plain = [w.rstrip(".") for w in words]
    spelled = " ".join(LEGAL.get(w, w) for w in plain if w not in DROPPED).split()
    heads = [w for w in spelled if w in HEADS]
    if not heads or len(plain) < 2:
        return None
    legal = [w for w in spelled if w in LEGAL.values() or w in ("working", "group")]
    rest = [w for w in spelled if w not in legal]
    if not rest:
        return None
    # The family name is the word nearest the front, or behind the comma where the kind stands first.
    family = rest[-1] if spelled[0] in legal else rest[0]
    theme = sorted(w[:SHORT] for w in rest if w != family)
    return "#" + " ".join(sorted({w[:SHORT] for w in legal})) + "/" + " ".join(theme), family


def person(name: str) -> tuple[str, str, str] | None:
    """(given, middle initials, family) of a person; given is a name or one initial."""
    text = re.sub(r"\.(?=[^\s.,-])", ". ", fold(name).replace("’", "'"))
    sides = [[w.strip(".") and w for w in re.findall(r"[^\s]+", s)] for s in text.split(",")]
    sides = [[w for w in s if w and w.rstrip(".") not in TITLES and w.rstrip(".") not in SUFFIXES] for s in sides]
    sides = [s for s in sides if s]
    if not sides:
        return None
    initial = lambda w: bool(re.fullmatch(r"[^\W\d_]\.?(?:-[^\W\d_]\.?)*|(?:[^\W\d_]\.)+", w))
    if len(sides) >= 2:
        family, given = sides[0], sides[1]
        while given and given[-1] in PARTICLES:
            family = [given.pop(), *family]
    else:
        ws = sides[0]
        if len(ws) == 1:
            return "", "", ws[0]
        if initial(ws[-1]) and not initial(ws[0]):
            k = len(ws)
            while k > 1 and initial(ws[k - 1]):
                k -= 1
            family, given = ws[:k], ws[k:]
        else:
            k = len(ws) - 1
            if k == 1 and (ws[1] in KNOWN and ws[0] not in KNOWN):
                family, given = ws[:1], ws[1:]
            else:
                while k > 1 and ws[k - 1] in PARTICLES:
                    k -= 1
                family, given = ws[k:], ws[:k]
    if not given:
        return "", "", " ".join(family)
    first = given[0]
    middle = "".join(w[0] for w in given[1:] if w not in PARTICLES)
    if initial(first):
        return first[0], middle, " ".join(family)
    first = first.rstrip(".")
    return NICKNAMES.get(first, first), middle, " ".join(family)


KNOWN = {*NICKNAMES, *NICKNAMES.values()}


def written(name: str) -> tuple[str, str, str] | None:
    """(given name, initial or theme; family name; middle initials)."""
    if not name or not name.strip():
        return None
    if org := organisation(name):
        return *org, ""
    p = person(name)
    return (p[0], p[2], p[1]) if p else None


def canonical(name: str) -> tuple[str, str] | None:
    """The form that all other rewritings start from: (given name, initial or theme; family name)."""
    w = written(name)
    return w[:2] if w else None


def near(a: str, b: str) -> bool:
    """At most one character inserted, left out or replaced, or two neighbours exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(x) > 1 and len(y) > 1 and x[2:] == y[2:])


FORM = T.StructType([T.StructField(c, T.StringType()) for c in ("given", "family", "middle")])


@F.pandas_udf(FORM)
def forms(names: pd.Series) -> pd.DataFrame:
    out = [written(n) or (None, None, None) for n in names]
    return pd.DataFrame(out, columns=["given", "family", "middle"])


@F.pandas_udf(T.BooleanType())
def within_one(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def slips(c: str):
    """A form and the form with each one of its characters left out."""
    n = F.length(c)
    return F.explode(F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n))))))


def spellings(papers: DataFrame, authors: str = "authors") -> DataFrame:
    """Every distinct name with its canonical form and frequency."""
    names = papers.select(F.explode(F.from_json(F.col(authors), "array<string>")).alias("name")).where("trim(name) <> ''")
    counted = cut(names.groupBy("name").agg(F.count("*").alias("n")))
    return counted.withColumn("form", forms("name")).select("name", "n", "form.*").where("family is not null")


def entities(papers: DataFrame, authors: str = "authors") -> DataFrame:
    """name, entity and score of every distinct spelling; equal entity: the same person or organisation."""
    names = cut(spellings(papers, authors))
    short = F.length("given") <= 1
    full = names.where(~short).groupBy("given", "family").agg(F.sum("n").alias("n")).withColumn("form", F.concat_ws("|", "given", "family"))
    full = cut(full)
    # Two usual given names are never a slip of one another. A name is usual if families other than the own bear it,
    # not much more rarely than any name a slip away from it: shares of rows, which do not change as a table grows.
    people = cut(full.where(~F.col("given").startswith("#")).groupBy("given").agg(F.sum("n").alias("rows")))
    spelled = people.select("given", "rows", slips("given").alias("key"))
    beside = spelled.join(spelled.toDF("given_y", "rows_y", "key").hint("merge"), "key").where("given <> given_y and rows < rows_y").select("given", "given_y", "rows_y").distinct().where(within_one("given", "given_y"))
    people = people.join(beside.groupBy("given").agg(F.max("rows_y").alias("most")).hint("merge"), "given", "left")
    full = full.join(people.hint("merge"), "given", "left").withColumn("others", F.col("rows") - F.col("n"))
    known = F.col("given").isin(sorted(set(NICKNAMES.values())))
    full = full.withColumn("usual", known | F.coalesce((F.col("others") > 0) & (F.col("others") >= SLIP * F.coalesce("most", F.lit(0))), F.lit(False)))
    borne = full.groupBy("family").agg(F.sum("n").alias("family_n"))
    full = full.join(borne.hint("merge"), "family").withColumn("shared", F.col("family_n") > F.col("n"))  # others bear the family name
    columns = ("form", "given", "family", "n", "usual", "shared")
    keys = full.select(*columns, slips("form").alias("key"))
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "ab")
    met = a.join(b.hint("merge"), "key").where("form_a <> form_b and (n_b, form_a) > (n_a, form_b)")
    # A form that is not much rarer is a slip only if it alone has its name, and the other form's name has others that bear it.
    met = met.where(f"n_b >= {TIMES} * n_a or (family_a <> family_b and not shared_a and shared_b) or (given_a <> given_b and not usual_a and usual_b)")
    met = met.where("not (usual_a and usual_b and given_a <> given_b)")
    met = met.where("given_a = given_b or family_a = family_b").where(~(F.col("given_a").startswith("#") & (F.col("given_a") != F.col("given_b"))))
    met = met.drop("key").distinct().where(within_one("form_a", "form_b"))
    to = met.groupBy("form_a").agg(F.max_by("form_b", F.struct("n_b", "form_b")).alias("to"))
    root = cut(full.select("form", "given", "family", "n").join(to.hint("merge"), full["form"] == to["form_a"], "left").select("form", "given", "family", "n", F.coalesce("to", "form").alias("root")))
    while True:  # follow the slips of slips
        up = root.select(F.col("form").alias("root"), F.col("root").alias("next"))
        new = cut(root.join(up.hint("merge"), "root").select("form", "given", "family", "n", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        root = new.drop("moved")
        if new.where("moved").isEmpty():
            break

    # Initials: the persons of the family name, or of one within a slip of it, with this first letter.
    heads = root.where(~F.col("given").startswith("#") & (F.length("given") > 1)).select(F.substring("given", 1, 1).alias("i"), "family", "root", "n")
    heads = heads.groupBy("i", "family", "root").agg(F.sum("n").alias("n"))
    single = F.count("*").over(_by("i", "family")).alias("persons")
    heads = heads.select("i", "family", "root", "n", single)
    initials = names.where(F.length("given") == 1).groupBy(F.col("given").alias("i"), "family").agg(F.sum("n").alias("n_i"))
    direct = initials.join(heads.hint("merge"), ["i", "family"]).groupBy("i", "family").agg(F.max("persons").alias("persons"), F.max_by("root", F.struct("n", "root")).alias("root"))
    lone = initials.join(direct.hint("merge"), ["i", "family"], "left_anti").select("i", "family", slips("family").alias("key"))
    around = heads.select(F.col("i").alias("j"), F.col("family").alias("other"), "root", "n", slips("family").alias("key2"))
    by_slip = lone.join(around.hint("merge"), (F.col("i") == F.col("j")) & (F.col("key") == F.col("key2"))).where(F.col("family") != F.col("other")).select("i", "family", "other", "root", "n").distinct()
    by_slip = by_slip.where(within_one("family", "other")).groupBy("i", "family").agg(F.count_distinct("root").alias("persons"), F.max_by("root", F.struct("n", "root")).alias("root"))
    led = direct.unionByName(by_slip).select(F.col("i").alias("given"), "family", "persons", F.when(F.col("persons") == 1, F.col("root")).alias("leads"))

    one = names.join(root.select("given", "family", "root").hint("merge"), ["given", "family"], "left").join(led.hint("merge"), ["given", "family"], "left")
    one = one.withColumn("entity", F.coalesce("root", "leads", F.concat_ws("|", "given", "family")))
    rows = root.groupBy("root").agg(F.sum(F.when(F.col("form") == F.col("root"), F.col("n"))).alias("root_n"))
    own = root.select("given", "family", F.col("n").alias("form_n"))
    one = one.join(rows.hint("merge"), "root", "left").join(own.hint("merge"), ["given", "family"], "left")
    # Different middle initials of one given and family name are different persons.
    middles = one.where("middle <> ''").groupBy("entity").agg(F.count_distinct(F.substring("middle", 1, 1)).alias("middles"))
    one = one.join(middles.hint("merge"), "entity", "left")
    apart = (F.col("middles") > 1) & (F.col("middle") != "")
    entity = F.when(apart, F.concat_ws("|", "entity", F.substring("middle", 1, 1))).otherwise(F.col("entity"))
    slip = F.col("root_n") / (F.col("root_n") + F.col("form_n"))
    score = F.when(F.length("given") > 1, F.when(F.col("root") == F.concat_ws("|", "given", "family"), 1.0).otherwise(slip)).otherwise(1.0 / F.coalesce("persons", F.lit(1)))
    return one.select("name", "n", entity.alias("entity"), F.round(score, 4).alias("score"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(entities(table(spark, sf_dir, "papers").select("authors")).select("entity", "name"))
    a, b = e.withColumnRenamed("name", "name_a"), e.withColumnRenamed("name", "name_b")
    return a.join(b.hint("merge"), "entity").where("name_a < name_b").select("name_a", "name_b")


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(table(spark, sf_dir, "papers").select("authors"))


QUERIES = {"p7_found": p7_found, "p7_entities": p7_entities}
