"""Matching of entities across sources that share no key.

Label-model linkage. Candidate pairs come from several blocking keys, each made
of at least two attributes, so none of them is hot. Heuristic matching
functions vote on each pair, one group of them for each kind of evidence:
docket number, case name, filing date, court. A generative model with a latent
match variable explains the votes; functions of one group share the same text
and are correlated, so the model holds the joint distribution of each group's
votes, and groups are independent given the match. It is fitted by EM over the
counts of distinct vote patterns of all pairs (a few thousand rows however
many pairs), and yields the posterior of each pattern, which is the confidence.
Each listed row keeps its best docket where the posterior reaches ``CUT`` and
no other docket is as likely.

Defined results. Rows with nothing to block on match nothing. NULL or blank
attributes abstain. Ties between dockets of equal posterior give no match.
Repeated rows with one id count once. Empty tables give an empty table.
"""

from __future__ import annotations


import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.names import one_per_id
from quillstone.session import materialise

CUT = 0.5
ROUNDS = 200

#: Words of captions that stand for one another, and words that say little.
_SAME = {
    "pharmaceuticals": "pharma", "pharmaceutical": "pharma", "incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd", "insurance": "ins", "group": "grp", "medical": "med",
    "estate": "est", "department": "dept", "us": "usa", "america": "usa", "properties": "props", "logistics": "logist", "systems": "sys", "mutual": "mut", "airways": "airw", "software": "softw", "holdings": "hold",
    "international": "intl", "association": "assn", "national": "natl", "brothers": "bros", "university": "univ", "commission": "comm", "commissioner": "comm", "district": "dist", "county": "cty",
}
_NOISE = {"et", "al", "the", "of", "and", "v", "vs", "versus", "in", "re", "matter", "plaintiff", "defendant", "sealed", "lead", "case", "does", "doe", "united", "states", "state", "usa", "inc", "corp", "co", "llc", "ltd", "lp", "grp", "ex", "parte", "est", "aka", "dba", "jr", "sr", "ii", "iii"}
_DASHES = "‐‑‒–—―−"


def number_parts(c: Column) -> Column:
    """struct(office, yy, kind, serial) of a docket number in any of its spellings; NULL parts where absent."""
    s = F.lower(F.translate(F.coalesce(c, F.lit("")), _DASHES + "_", "-" * (len(_DASHES) + 1)))
    s = F.regexp_replace(F.trim(F.regexp_replace(s, r"\b(?:civil|criminal|action|case|docket|no|nos|number|cause)\b\.?:?", " ")), r"\s+", " ")
    get = lambda p, g: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    full, kind_first, kind_last, bare = r"(?:^|[: ]|\b\d:)(?:\d\d)?(\d\d)[- ]?([a-z]{2})[- ]?0*(\d{1,6})(?!\d)", r"^(?:\d:)?([a-z]{2})[- ]?(?:\d\d)?(\d\d)[- ]0*(\d{1,6})(?!\d)", r"^(?:\d:)?(?:\d\d)?(\d\d)-0*(\d{1,6})-([a-z]{2})\b", r"^(?:\d:)?(?:\d\d)?(\d\d)-0*(\d{1,6})(?!\d)"
    return F.struct(
        get(r"^(\d):", 1).alias("office"),
        F.coalesce(get(full, 1), get(kind_first, 2), get(kind_last, 1), get(bare, 1)).alias("yy"),
        F.coalesce(get(full, 2), get(kind_first, 1), get(kind_last, 3)).alias("kind"),
        F.coalesce(get(full, 3), get(kind_first, 3), get(kind_last, 2), get(bare, 2)).alias("serial"),
    )


def court_key(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", ""), F.lit(""))


def caption_tokens(c: Column) -> Column:
    """Distinct words of a caption, lower case, without marks, single letters and words that say little."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\([^)]*\)", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\.", ""), r"[^\p{L}\p{N}]+", " ")
    words = F.split(F.trim(s), " ")
    same = F.create_map(*[F.lit(x) for kv in _SAME.items() for x in kv])
    words = F.transform(words, lambda w: F.coalesce(same[w], w))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*_NOISE)))


def _prepared(df: DataFrame, key: str) -> DataFrame:
    rows = one_per_id(df.select(key, "court_id", "docket_number", "case_name", "date_filed"), key).select(
        F.col(key).alias("id"), court_key(F.col("court_id")).alias("court"), number_parts(F.col("docket_number")).alias("num"), F.col("case_name").alias("name"), F.col("date_filed").cast("date").alias("filed"), caption_tokens(F.col("case_name")).alias("words"),
    )
    return rows.select("id", "court", "num.*", "name", "filed", "words")


def _keys(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """(id, key): blocking keys of each row; NULL keys are dropped."""
    # Only the rarest words of a caption make keys, so a date or number that very many rows share stays harmless.
    word = rows.join(rare.select("id", "rarest"), "id").select("id", "yy", "serial", "filed", F.explode("rarest").alias("w"))
    number = F.concat_ws("-", "yy", "serial")
    has_number = F.col("yy").isNotNull() & F.col("serial").isNotNull()
    parts = [
        rows.select("id", F.when(has_number & F.col("court").isNotNull(), F.concat_ws("|", F.lit("a"), number, F.substring("court", 1, 4))).alias("key")),
        rows.select("id", F.when(has_number & F.col("filed").isNotNull(), F.concat_ws("|", F.lit("b"), number, F.col("filed").cast("string"))).alias("key")),
        word.select("id", F.when(F.col("filed").isNotNull(), F.concat_ws("|", F.lit("c"), "w", F.col("filed").cast("string"))).alias("key")),
        word.select("id", F.when(has_number, F.concat_ws("|", F.lit("d"), "w", number)).alias("key")),
        rare.select("id", F.when(F.col("court").isNotNull() & (F.size("rarest") >= 2), F.concat_ws("|", F.lit("e"), F.array_join(F.array_sort(F.slice("rarest", 1, 2)), "+"), F.substring("court", 1, 4))).alias("key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("key").isNotNull()).distinct()


def _rarest(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The four rarest words of each caption, rarest first, by the counts over all dockets."""
    words = rows.select("id", "court", F.explode("words").alias("w")).join(counts, "w")
    four = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", "w"))), 1, 4), lambda x: x["w"])
    return words.groupBy("id", "court").agg(four.alias("rarest"))


def _fold(w: str) -> str:
    return w.translate(_SCAN)


_SCAN = str.maketrans("0158|", "olsbl")


def _near(a: str, b: str) -> bool:
    """Whether two words differ by a slip: one edit or swap, two in long words."""
    if a == b or _fold(a) == _fold(b):
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4:
        return min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a)) and abs(len(a) - len(b)) <= 6 and min(len(a), len(b)) >= 5
    most = 1 if min(len(a), len(b)) < 8 else 2
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        prev2, prev = prev, row
    return prev[-1] <= most


def _names_vote(a: list[str], b: list[str], caption: str) -> str:
    """Vote of the case name functions: coverage of either name by the other, or of one party of the docket's caption."""
    if not a or not b:
        return "0"
    hit_b = sum(any(_near(x, y) for x in a) for y in b)
    if hit_b == len(b):
        return "all"
    hit_a = sum(any(_near(x, y) for y in b) for x in a)
    if hit_a == len(a) or hit_b >= 0.6 * len(b):
        return "most"
    if hit_b:
        sides = [[w for w in re.findall(r"[^\W_]+", side.lower()) if w in b] for side in _VERSUS.split(caption or "")]
        if any(side and all(any(_near(x, y) for x in a) for y in side) for side in sides):
            return "side"
    return "some" if hit_b or hit_a else "none"


_VERSUS = re.compile(r"\s+(?:v|vs|versus|-v-)\.?\s+", re.I)


def votes(batches: Iterator) -> Iterator:
    """The votes on each pair of a batch: number, name, date and court."""
    import pyarrow as pa

    for b in batches:
        c = {n: b.column(n).to_pylist() for n in b.schema.names}
        number, name, date, court = [], [], [], []
        for i in range(b.num_rows):
            fy, fs, fk, fo = c["yy"][i], c["serial"][i], c["kind"][i], c["office"][i]
            if fy is None or fs is None or c["d_serial"][i] is None:
                number.append("0")
            else:
                same = fy == c["d_yy"][i] and fs == c["d_serial"][i]
                kind = "0" if fk is None or c["d_kind"][i] is None else "=" if fk == c["d_kind"][i] else "x"
                office = "0" if fo is None or c["d_office"][i] is None else "=" if fo == c["d_office"][i] else "x"
                slip = not same and (fy == c["d_yy"][i] and _digits_near(fs, c["d_serial"][i]) or fs == c["d_serial"][i])
                number.append(f"same{kind}{office}" if same else f"slip{kind}" if slip else "other")
            name.append(_names_vote(c["words"][i], c["d_words"][i], c["d_name"][i]))
            f, d = c["filed"][i], c["d_filed"][i]
            gap = None if f is None or d is None else abs((f - d).days)
            date.append("0" if gap is None else "same" if gap == 0 else "near" if gap <= 7 else "year" if f.year == d.year or _swapped(f, d) else "other")
            f, d = c["court"][i], c["d_court"][i]
            court.append("0" if f is None or d is None else "same" if f == d else "near" if f.startswith(d) or d.startswith(f) or sorted(f) == sorted(d) else "half" if f[:2] == d[:2] else "other")
        yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("docket_id"), *[pa.array(x, pa.string()) for x in (number, name, date, court)]], names=["row_id", "docket_id", "number", "name", "date", "court"])


def _digits_near(a: str, b: str) -> bool:
    """Whether two serials, padded as they are printed, differ by one digit or a swap of neighbours."""
    a, b = a.zfill(5), b.zfill(5)
    if len(a) == len(b):
        d = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    return False


def _swapped(f, d) -> bool:
    return f.month == d.month and f.day == d.day


_GROUPS = ("number", "name", "date", "court")


def fit_label_model(patterns: list[tuple[str, ...]], counts: np.ndarray) -> np.ndarray:
    """Posterior of a match for each vote pattern, by EM over pattern counts.

    The latent variable has one value for a match and three for the ways in
    which pairs come to resemble one another without being one: the same
    parties in another case, the same number in another court or kind, and a
    shared word on a shared date. Rules only say where it starts: agreement in
    three kinds of evidence, or in two and against none, is a match. What each
    vote is worth in each class is learned.
    """
    cols = [np.unique([p[g] for p in patterns], return_inverse=True) for g in range(len(_GROUPS))]
    agrees = {"number": ("same==", "same=0", "same0=", "same00", "slip=", "slip0"), "name": ("all", "most"), "date": ("same", "near"), "court": ("same", "near")}
    against = {"number": ("other",), "name": ("none",), "date": ("other",), "court": ("other", "half")}
    yes = np.array([[p[g] in agrees[n] for g, n in enumerate(_GROUPS)] for p in patterns])
    no = np.array([[p[g] in against[n] for g, n in enumerate(_GROUPS)] for p in patterns])
    match = (yes.sum(1) >= 3) & (yes[:, 1] | (no.sum(1) == 0)) | (yes.sum(1) >= 2) & (no.sum(1) == 0) & yes[:, 1]
    parties = ~match & yes[:, 1]
    number = ~match & ~parties & np.array([p[0].startswith("same") for p in patterns])
    post = np.stack([match, parties, number, ~(match | parties | number)], axis=1) * 0.94 + 0.015
    for _ in range(ROUNDS):
        w = counts[:, None] * post
        share = (w.sum(0) + 1) / (w.sum() + 4)
        z = np.tile(np.log(share), (len(patterns), 1))
        for values, at in cols:
            p = np.stack([np.bincount(at, w[:, k], len(values)) for k in range(4)], axis=1) + 0.2
            silent = values == "0"  # abstaining says nothing: as likely in every class
            if silent.any() and not silent.all():
                q = counts[silent[at]].sum() / counts.sum()
                p[~silent] *= (1 - q) / p[~silent].sum(0)
                p[silent] = q
            z += np.log(p / p.sum(0))[at]
        z -= z.max(1, keepdims=True)
        new = np.exp(z)
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post[:, 0]


def link_dockets(listed: DataFrame, dockets: DataFrame) -> DataFrame:
    """(row_id, docket_id, confidence) of each listed row that belongs to a docket."""
    left, right = materialise(_prepared(listed, "id"), "listed"), materialise(_prepared(dockets, "id"), "dockets")
    counts = right.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    lk, rk = _keys(left, _rarest(left, counts)), _keys(right, _rarest(right, counts))
    pairs = lk.withColumnRenamed("id", "row_id").join(rk.withColumnRenamed("id", "docket_id"), "key").select("row_id", "docket_id").distinct()
    other = right.select(*[F.col(c).alias("docket_id" if c == "id" else f"d_{c}") for c in right.columns])
    full = pairs.join(left.withColumnRenamed("id", "row_id"), "row_id").join(other, "docket_id")
    kinds = {f.name: f.dataType.simpleString() for f in full.schema}
    voted = materialise(full.mapInArrow(votes, f"row_id {kinds['row_id']}, docket_id {kinds['docket_id']}, number string, name string, date string, court string"), "votes")
    patterns = voted.groupBy(*_GROUPS).count().collect()  # at most the product of the votes' values
    if not patterns:
        return voted.select("row_id", "docket_id", F.lit(0.0).alias("confidence")).limit(0)
    keys = [tuple(r[g] for g in _GROUPS) for r in patterns]
    post = fit_label_model(keys, np.array([r["count"] for r in patterns], float))
    spark = listed.sparkSession
    table = spark.createDataFrame([(*k, float(p)) for k, p in zip(keys, post)], ", ".join(f"{g} string" for g in _GROUPS) + ", confidence double")
    scored = voted.join(F.broadcast(table), list(_GROUPS))
    best = scored.groupBy("row_id").agg(F.max(F.struct("confidence", "docket_id")).alias("best"), F.max_by("docket_id", F.struct("confidence", -F.col("docket_id"))).alias("rival"))
    # the largest and the smallest id of the best confidence differ only in a tie
    return best.where((F.col("best.confidence") >= CUT) & (F.col("best.docket_id") == F.col("rival"))).select("row_id", F.col("best.docket_id").alias("docket_id"), F.col("best.confidence").alias("confidence"))
