"""Variant spellings of names typed by people, linked to one entity.

A symmetric-delete neighbourhood index finds spellings close to one another:
every surname is filed under itself and under itself without each of its
letters, so two spellings one edit or one swap apart share a file. Inside a
file the parts of two names are aligned by optimal assignment: given names
match given names in any order, an initial or an abbreviation may stand for a
full name, nicknames stand for the names they are known to shorten.

Judges: typed names are looked up among the people of the same court and lead
to the root of the alias chain. The best alignment wins; where two people
align equally well and nothing else tells them apart, there is no link.

Attorneys: a link needs a compatible name and a shared firm, phone, fax or
e-mail address. Rows alike in name and evidence are folded into one
representative first, so a group of copies is never compared pair by pair;
links between representatives are closed into classes by label propagation
over written tables. Pairs are expanded only at the end, as the result asks.

Defined results. NULL and blank names link to nothing, as do fillers such as
"unassigned". People on alias loops have no root and are no target. Repeated
rows count once. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.components import classes
from quillstone.operators.hierarchy import resolve_hierarchy
from quillstone.session import materialise

#: Short forms of given names, beside those that alias rows teach.
_SHORT = {
    "william": "bill will billy", "robert": "bob rob bobby", "richard": "dick rick rich", "james": "jim jamie jimmy", "john": "jack johnny", "charles": "chuck charlie", "edward": "ed ted eddie", "thomas": "tom tommy",
    "elizabeth": "liz beth betsy betty eliza", "katherine": "kate kathy katie kat", "margaret": "maggie peggy meg", "patricia": "pat trish patty", "michael": "mike mick", "joseph": "joe joey", "daniel": "dan danny",
    "benjamin": "ben benny", "nicholas": "nick nicky", "christopher": "chris kit", "gregory": "greg", "lawrence": "larry", "harold": "hal harry", "samuel": "sam sammy", "andrew": "andy drew", "rebecca": "becky",
    "deborah": "debbie deb", "susan": "sue susie", "victoria": "vicky", "jennifer": "jen jenny", "theodore": "ted theo teddy", "alexandra": "alex sandra", "francisco": "paco", "judith": "judy", "david": "dave", "matthew": "matt", "anthony": "tony",
}
_TITLES = {"hon", "honorable", "honourable", "judge", "justice", "chief", "magistrate", "senior", "district", "circuit", "presiding", "associate", "mr", "mrs", "ms", "miss", "dr", "the", "esq", "attorney", "prof", "j", "cj"}
_SUFFIXES = {"jr": "jr", "sr": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii"}
_FILLERS = r"(?i)^\W*(?:un-?assigned|unknown|none|n/?a|tbd|vacant|not assigned|pending|null)?\W*$"
_ORG = re.compile(r"\b(?:llp|llc|p\.?\s?c|pllc|l\.?l\.?p|p\.?a|inc|ltd|law|legal|offices?|off|associates|assocs?|partners|ptnrs|group|firm|society|soc|defenders?|public|aid|&|clinic|department|dept|county|city|state|united states|u\.?s\.?|bureau|agency|foundation|center|co)\b|&", re.I)
_ORG_SAME = {"off": "office", "offices": "office", "ptnrs": "partners", "partner": "partners", "assocs": "associates", "assoc": "associates", "soc": "society", "pub": "public", "def": "defender", "defs": "defender", "defenders": "defender", "dept": "department", "pc": "pc", "and": "", "of": "", "the": "", "c/o": "", "co": "co", "lgl": "legal", "svcs": "services"}


# Alignment -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> int:
    """0 if equal, 1 if one edit or swap apart, 9 otherwise; words under four letters must be equal."""
    if a == b:
        return 0
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return 9
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:]):
        return 1
    return 9


class Nicknames:
    def __init__(self, pairs: list[tuple[str, str]]):
        self.of: dict[str, set[str]] = {}
        for full, shorts in _SHORT.items():
            for s in shorts.split():
                self.add(full, s)
        for a, b in pairs:
            self.add(a, b)

    def add(self, a: str, b: str) -> None:
        self.of.setdefault(a, set()).add(b)
        self.of.setdefault(b, set()).add(a)

    def alike(self, a: str, b: str) -> bool:
        x, y = self.of.get(a, ()), self.of.get(b, ())
        return b in x or a in y or bool(x and y and set(x) & set(y))


class Name:
    """Parts of a typed name."""

    __slots__ = ("given", "last", "suffix")

    def __init__(self, given: list[str], last: str, suffix: str):
        self.given, self.last, self.suffix = given, last, suffix


_PART = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d(?:nd|rd)")


def letters(word: str) -> str:
    """A surname in the form it is compared by: small letters, without marks and spaces."""
    return "".join(c for c in word.lower() if c.isalpha())


@lru_cache(maxsize=100_000)
def parse(typed: str, surname_words: int = 1) -> Name | None:
    """A typed name with its parts in order, the last ``surname_words`` words taken as surname; None where no surname is left."""
    comma = re.match(r"\s*([^,]+),\s*(.+)$", typed)
    if comma and (words := _PART.findall(comma.group(2).lower())) and words[0] not in _SUFFIXES:
        rest = re.split(r",", comma.group(2), maxsplit=1)
        typed = rest[0] + " " + comma.group(1) + " " + " ".join(rest[1:])
        # "Smith Jr., John": the suffix stands with the surname
    words = _PART.findall(typed)
    given, suffix = [], ""
    kept = []
    for i, w in enumerate(words):
        low = w.lower()
        if low in _SUFFIXES and i:
            suffix = _SUFFIXES[low]
        elif low in _TITLES and not (len(low) == 1 and len(words) > 1 and i < len(words) - 1):
            continue
        else:
            kept.append(w)
    if not kept:
        return None
    last = " ".join(kept[-surname_words:])
    first = kept[:-surname_words]
    if len(last) == 1 and first and len(first[0]) > 2:  # "Smith J"
        first, last = [*first[1:], last], first[0]
    for w in first:
        if len(w) in (2, 3) and w.isupper() and len(first) == 1 and w.lower() not in ("joe", "ann", "sue", "tom", "jim", "bob", "dan", "ben", "sam", "ted", "liz", "jen", "rob", "pat", "hal", "ida", "leo", "ray", "roy", "max", "eva", "ivy", "guy", "ira") and not last.isupper():
            given.extend(w.lower())
        else:
            given.append(w.lower())
    return Name(given, letters(last), suffix)


def _part_cost(a: str, b: str, nick: Nicknames) -> float:
    """Cost of taking one given name for another; 9 where they contradict."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 9.0
    if nick.alike(a, b):
        return 0.3
    if near(a, b) < 9:
        return 0.4
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short):
        return 0.4
    for alt in nick.of.get(b, ()):
        if near(a, alt) == 1:
            return 0.6
    for alt in nick.of.get(a, ()):
        if near(alt, b) == 1:
            return 0.6
    return 9.0


def align(a: Name, b: Name, nick: Nicknames) -> float | None:
    """Cost of the best assignment of the parts of two names; None where they contradict."""
    slip = near(a.last, b.last)
    if slip == 9:
        return None
    if a.suffix and b.suffix and a.suffix != b.suffix:
        return None
    cost = 0.6 * slip + (0.25 if a.suffix != b.suffix else 0.0)
    x, y = (a.given, b.given) if len(a.given) <= len(b.given) else (b.given, a.given)
    if not x:
        return cost + (1.0 if y else 0.0)
    best = assign([[(_NEVER if (c := _part_cost(p, q, nick)) >= 9 else c) + (0.0 if i == j else 0.3) for j, q in enumerate(y)] for i, p in enumerate(x)])
    return None if best >= _NEVER else cost + best + 0.15 * (len(y) - len(x))


_NEVER = 1e6


def assign(cost: list[list[float]]) -> float:
    """Least sum of an assignment of each row to a column of its own (Hungarian method); there are as many columns as rows at least."""
    n, m = len(cost), len(cost[0])
    if n == 1:
        return min(cost[0])
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sum(cost[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


# Neighbourhood index ---------------------------------------------------------------------------------------------


def delete_keys(word: Column) -> Column:
    """A word and the word without each of its letters, as an array."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= 4, cut).otherwise(F.array().cast("array<string>"))))


def _surname_words(name: Column) -> Column:
    """Words of a typed name that may be its surname, and two or three neighbours taken as one (O'Brien, Smith-Jones, Van Dyke, De La Cruz)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}]+", " ")), " ")
    joined = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), ""))
    none = F.array().cast("array<string>")
    every = F.concat(words, *[F.when(F.size(words) >= n, joined(n)).otherwise(none) for n in (2, 3)])
    return F.array_distinct(F.filter(every, lambda w: F.length(w) >= 2))


def one_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row of each id, always the same one: the least by its columns in order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__row")).select(key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


#: A pair of given names enters the nicknames from this share of all alias pairs on (and from two), so at most its inverse travels.
NICKNAME_SHARE = 1e-5


def _nickname_pairs(people: DataFrame) -> list[tuple[str, str]]:
    """Given names that an alias row and its target pair under one surname, at least twice; no more than 1 / ``NICKNAME_SHARE`` of them."""
    first = F.lower(F.trim("name_first"))
    p = people.select("id", "is_alias_of_id", first.alias("f"), F.lower(F.trim("name_last")).alias("l")).where(F.length("f") > 1)
    q = p.select(F.col("id").alias("is_alias_of_id"), F.col("f").alias("g"), F.col("l").alias("m"))
    both = materialise(p.join(q, "is_alias_of_id").where((F.col("l") == F.col("m")) & (F.col("f") != F.col("g"))).groupBy("f", "g").count(), "nicknames")
    least = max(2, NICKNAME_SHARE * (both.agg(F.sum("count")).first()[0] or 0))
    return sorted((r["f"], r["g"]) for r in both.where(F.col("count") >= least).collect())


# Judges ------------------------------------------------------------------------------------------------------------


def link_judges(typed: DataFrame, people: DataFrame) -> DataFrame:
    """(src, row_id, person_id, cost): the root person of each typed judge.

    ``typed`` has src, row_id, court_id, name, date (used only where two people of one court fit equally well).
    """
    spark = typed.sparkSession
    court = lambda c: F.lower(F.trim(c))
    t = materialise(typed.where(~F.col("name").rlike(_FILLERS) & F.col("court_id").isNotNull()).select("src", "row_id", court(F.col("court_id")).alias("court"), F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"), "date"), "typed")
    people = one_per_id(people.select("id", "is_alias_of_id", "court_id", "name_first", "name_middle", "name_last", "name_suffix", "date_start", "date_termination"))
    roots = resolve_hierarchy(people, "id", "is_alias_of_id").where("depth >= 0").select(F.col("node").cast("bigint").alias("id"), F.col("root").cast("bigint").alias("root"))
    p = materialise(
        people.join(roots, "id").where(F.length(F.trim("name_last")) > 0).select(
            "root", court(F.col("court_id")).alias("court"), F.lower(F.trim("name_first")).alias("first"), F.lower(F.trim("name_middle")).alias("middle"), F.regexp_replace(F.lower("name_last"), r"[^\p{L}]+", "").alias("last"), F.size(F.split(F.regexp_replace("name_last", r"^[^\p{L}]+|[^\p{L}]+$", ""), r"[^\p{L}]+")).alias("parts"), F.lower(F.trim("name_suffix")).alias("suffix"), "date_start", "date_termination",
        ), "judges",
    )
    nick = spark.sparkContext.broadcast(_nickname_pairs(people))
    words = t.select("court", "name").distinct().select("*", F.explode(_surname_words(F.col("name"))).alias("w"))
    # A word that is somebody's surname as it stands is no slip for another one.
    known = p.select(F.col("last").alias("w"), F.lit(True).alias("known")).distinct()
    spelled = words.join(known, "w", "left").groupBy("court", "name").agg(F.collect_set("w").alias("words"), F.collect_set(F.when(F.col("known"), F.col("w"))).alias("real"))
    left = spelled.select("court", "name", "real", F.explode(F.array_distinct(F.flatten(F.transform("words", delete_keys)))).alias("key"))
    right = p.where(F.col("court").isNotNull()).select("*", F.explode(delete_keys(F.col("last"))).alias("key"))
    pairs = left.join(right, ["court", "key"]).drop("key").distinct()

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        nicks = Nicknames(nick.value)
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            keep, cost = [], []
            for i in range(b.num_rows):
                typed_as = [n for k in {1, c["parts"][i]} if (n := parse(c["name"][i], k)) and near(n.last, c["last"][i]) < 9]
                if not typed_as:
                    continue
                a = min(typed_as, key=lambda n: near(n.last, c["last"][i]))
                given = [w for w in (*re.findall(r"[^\W\d_]+", c["first"][i] or ""), *re.findall(r"[^\W\d_]+", c["middle"][i] or "")) if w]
                who = Name(given, c["last"][i], _SUFFIXES.get((c["suffix"][i] or "").strip("."), ""))
                if a.last != who.last and a.last in c["real"][i]:
                    continue
                v = align(a, who, nicks)
                if v is not None:
                    keep.append(i)
                    cost.append(v)
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(n).take(pick) for n in ("court", "name", "root", "date_start", "date_termination")], pa.array(cost, pa.float64())], names=["court", "name", "root", "date_start", "date_termination", "cost"])

    scored = pairs.mapInArrow(score, "court string, name string, root bigint, date_start date, date_termination date, cost double")
    per_root = materialise(scored.groupBy("court", "name", "root").agg(F.min("cost").alias("cost"), F.min("date_start").alias("since"), F.max("date_termination").alias("until")), "judge-scores")
    best = per_root.groupBy("court", "name").agg(F.min("cost").alias("least"))
    close = per_root.join(best, ["court", "name"]).where(F.col("cost") <= F.col("least") + 0.1)
    hits = t.join(close, ["court", "name"])
    serving = (F.col("date").isNull() | ((F.col("since").isNull() | (F.col("date") >= F.date_sub("since", 365))) & (F.col("until").isNull() | (F.col("date") <= F.date_add("until", 365))))).cast("int")
    top = hits.withColumn("fit", F.struct(serving.alias("serving"), F.round(-F.col("cost"), 3).alias("near")))
    pick = top.groupBy("src", "row_id", "name").agg(F.max(F.struct("fit", "root")).alias("hi"), F.max(F.struct("fit", (-F.col("root")).alias("r"))).alias("lo"), F.min("cost").alias("cost"))
    sure = pick.where(F.col("hi.root") == -F.col("lo.r"))
    return sure.groupBy("src", "row_id", F.col("hi.root").alias("person_id")).agg(F.min("cost").alias("cost"))


# Attorneys ---------------------------------------------------------------------------------------------------------


def _digits(s: str | None) -> str:
    """Last ten digits of a phone number without extension."""
    d = re.sub(r"\D", "", re.split(r"(?i)\s*(?:ext|x)\.?\s*\d", s or "")[0])
    return d[-10:] if len(d) >= 10 else ""


def _email(s: str | None) -> str:
    s = re.sub(r"^\s*(?:mailto:|e-?mail:?)\s*|[<>]", "", (s or "").lower().strip())
    s = re.sub(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+", "@", s)
    s = re.sub(r"\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+", ".", s)
    return re.sub(r"\s+", "", s) if "@" in s else ""


def _org_key(s: str) -> str:
    """Words of an organisation's name in one spelling."""
    s = re.sub(r"(?i)^\s*c/o\s+", "", s).lower().replace(".", "")
    words = [_ORG_SAME.get(w, w) for w in re.findall(r"[^\W_]+", s)]
    return " ".join(w for w in words if w)


_RAW_PHONE = re.compile(r"(?:\+?1[ .\-])?\(?\d{3}\)?[ .\-/]?\s?\d{3}[ .\-]?\d{4}")
_RAW_EMAIL = re.compile(r"[\w.+\-]+\s?(?:@|[(\[]at[)\]]|\sat\s)\s?[\w\-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)[\w\-]+)+", re.I)


def profile(name: str | None, raw: str | None, phone: str | None, fax: str | None, email: str | None) -> tuple[str, str, list[str]] | None:
    """(kind, name key, evidence) of one row: kind 'p' or 'o'; the key holds the row's best spelling of the name."""
    name, raw = (name or "").strip(), raw or ""
    lines = [x.strip() for x in re.split(r"\r?\n", raw) if x.strip()]
    if len(lines) == 1:
        lines = [x.strip() for x in re.split(r",\s+(?=\S)", lines[0])]
    evidence = {f"t{d}" for d in (_digits(phone), *(_digits(x) for x in _RAW_PHONE.findall(raw))) if d}
    evidence |= {f"t{d}" for d in (_digits(fax),) if d}
    evidence |= {f"e{x}" for x in (_email(email), *(_email(x) for x in _RAW_EMAIL.findall(raw))) if x}
    firm = ""
    flat = ", ".join(lines) if "\n" not in raw.strip() else "\n".join(lines)
    for line in re.split(r"\n", flat) if "\n" in flat else [flat]:
        if m := re.search(r"(?:c/o\s+)?([^\n\d]*?(?:\bLLP|\bP\.C\.|& Associates|\bPublic Defender|\bLegal Aid Society|Law Offices of[^,\n]*|\bP\.?C\b|\bPLLC|\bLLC))", line):
            seg = m.group(1)
            firm = _org_key(seg)
            if "\n" not in raw.strip():  # one line: "Person, Firm, address"
                parts = seg.split(", ")
                if len(parts) > 1 and parse(parts[0]) and not _ORG.search(parts[0]) and (parse(parts[0]).given or name and parse(name) and near(parse(name).last, parse(parts[0]).last) < 9 and len(parts) > 2):
                    skip = 2 if re.match(r"^[^\s]+$", parts[0]) and len(parts) > 2 else 1
                    firm = _org_key(", ".join(parts[skip:]))
            break
    if firm:
        evidence.add(f"f{firm}")
    if name and _ORG.search(name):
        key = _org_key(name)
        return ("o", key, sorted({*evidence, f"f{key}"})) if key else None
    n = parse(name) if name else None
    if n is None or len(n.last) < 2:
        return None
    if lines and not _ORG.search(lines[0]) and (first := parse(lines[0] if "," not in lines[0] or len(lines) == 1 else lines[0])) and near(first.last, n.last) < 9:
        # the contact block spells the name too: the fuller given name counts
        if n.given and first.given and len(n.given[0]) == 1 and len(first.given[0]) > 1 and first.given[0][0] == n.given[0][0]:
            n = Name([first.given[0], *n.given[1:]], n.last, n.suffix)
        elif not n.given:
            n = Name(first.given, n.last, n.suffix)
    return "p", "|".join([n.last, " ".join(n.given), n.suffix]), sorted(evidence)


def _unkey(k: str) -> Name:
    last, given, suffix = k.split("|")
    return Name(given.split(), last, suffix)


def org_near(a: str, b: str) -> bool:
    """Whether two organisation keys are one name: the same words, slips and abbreviations allowed."""
    x, y = a.split(), b.split()
    if abs(len(x) - len(y)) > 1:
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    left = list(y)
    for w in x:
        hit = next((v for v in left if v == w), None) or next((v for v in left if near(w, v) < 9 or len(w) >= 2 and v.startswith(w) and len(w) >= 3), None)
        if hit is None:
            return False
        left.remove(hit)
    return all(len(w) <= 3 or w in ("office", "society", "partners", "associates") for w in left)


def attorney_classes(attorneys: DataFrame, people: DataFrame) -> DataFrame:
    """(id, cls): rows of one person or organisation share cls, the least id among them."""
    spark = attorneys.sparkSession
    nick = spark.sparkContext.broadcast(_nickname_pairs(people))
    rows = one_per_id(attorneys.select("id", "attorney_name", "contact_raw", "phone", "fax", "email")).select(F.col("id").cast("bigint").alias("id"), "attorney_name", "contact_raw", "phone", "fax", "email")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [(i, p) for i, r in enumerate(zip(*[b.column(n).to_pylist() for n in ("attorney_name", "contact_raw", "phone", "fax", "email")])) if (p := profile(*r))]
            pick = pa.array([i for i, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pick), pa.array([p[0] for _, p in got], pa.string()), pa.array([p[1] for _, p in got], pa.string()), pa.array([p[2] for _, p in got], pa.list_(pa.string()))], names=["id", "kind", "name", "evidence"])

    prof = materialise(rows.mapInArrow(read, "id bigint, kind string, name string, evidence array<string>"), "profiles")
    shown = prof.select("id", "kind", "name", F.explode("evidence").alias("ev"))
    # Rows alike in name and one piece of evidence: one representative, star links.
    rep = materialise(shown.groupBy("kind", "name", "ev").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "representatives")
    star = shown.join(rep, ["kind", "name", "ev"]).where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # Organisations of one name are one organisation, whatever else they share.
    word = F.when(F.col("kind") == "p", F.array(F.split_part("name", F.lit("|"), F.lit(1)))).otherwise(F.filter(F.split("name", " "), lambda w: F.length(w) >= 5))
    filed = rep.select("kind", "name", "ev", "rep", F.explode(F.array_distinct(F.flatten(F.transform(word, delete_keys)))).alias("key"))
    l, r = filed.select("kind", "ev", "key", F.col("name").alias("na"), F.col("rep").alias("a")), filed.select("kind", "ev", "key", F.col("name").alias("nb"), F.col("rep").alias("b"))
    cand = l.join(r, ["kind", "ev", "key"]).where("na < nb").select("kind", "ev", "na", "nb", "a", "b").distinct()

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        nicks = Nicknames(nick.value)
        for b in batches:
            keep, weak = [], []
            for i, (kind, na, nb) in enumerate(zip(*[b.column(n).to_pylist() for n in ("kind", "na", "nb")])):
                if kind == "o":
                    ok, w = org_near(na, nb), False
                else:
                    x, y = _unkey(na), _unkey(nb)
                    v = align(x, y, nicks)
                    ok = v is not None and bool(x.given) and bool(y.given) and v < 2.2
                    # only an initial against a full name: true only where one full name fits
                    w = ok and (len(x.given[0]) == 1) != (len(y.given[0]) == 1)
                if ok:
                    keep.append(i)
                    weak.append(w)
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(n).take(pick) for n in ("ev", "na", "nb", "a", "b")], pa.array(weak, pa.bool_())], names=["ev", "na", "nb", "a", "b", "weak"])

    links = materialise(cand.mapInArrow(judge, "ev string, na string, nb string, a bigint, b bigint, weak boolean"), "name-links")
    # An initial fits a family: with more than one given name beside it under one piece of evidence it links to none by that evidence.
    given = lambda n: F.split_part(F.split_part(n, F.lit("|"), F.lit(2)), F.lit(" "), F.lit(1))
    one = F.length(given(F.col("na"))) == 1
    weak = links.where("weak").select("ev", F.when(one, F.col("na")).otherwise(F.col("nb")).alias("short"), F.substring(F.when(one, given(F.col("nb"))).otherwise(given(F.col("na"))), 1, 3).alias("full"))
    torn = weak.groupBy("ev", "short").agg(F.countDistinct("full").alias("fulls")).where("fulls > 1").select("ev", "short", F.lit(True).alias("torn"))
    marked = links.withColumn("short", F.when(one, F.col("na")).otherwise(F.col("nb"))).join(torn, ["ev", "short"], "left")
    edges = marked.where(~(F.col("weak") & F.col("torn").isNotNull())).select("a", "b")
    return classes(prof.select("id"), star.unionByName(edges).distinct())


def class_pairs(cls: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first, of every two rows of one class."""
    a, b = cls.select("cls", F.col("id").alias("id_a")), cls.select("cls", F.col("id").alias("id_b"))
    return a.join(b, "cls").where("id_a < id_b").select("id_a", "id_b")
