"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that count as a hyphen.
DASHES = "-–—‐‑‒―"


def first_filled(*cols: Column) -> Column:
    """The first column that is neither NULL nor empty; NULL if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def filled_source(**cols: Column) -> Column:
    """The name of the first filled column."""
    out = None
    for name, c in cols.items():
        ok = F.coalesce(F.length(c) > 0, F.lit(False))
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out


def hyphenated(c: Column) -> Column:
    """Runs of dashes of any kind as one hyphen."""
    return F.regexp_replace(c, f"[{DASHES}]+", "-")


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"))


def truncated(c: Column, length: int, ellipsis: str = "") -> Column:
    """Cut at the last space that leaves room for the ellipsis; at the length itself where there is no space."""
    room = length - len(ellipsis)
    head = F.substring(c, 1, room + 1)
    at_space = F.regexp_extract(head, "(?s)^(.*) ", 1)
    cut = F.when(F.instr(head, " ") > 0, at_space).otherwise(F.substring(c, 1, room))
    return F.when(F.length(c) <= length, c).otherwise(F.concat(cut, F.lit(ellipsis)))


def wrapped(c: Column, length: int) -> Column:
    """Words up to ``length`` characters, and the one word that goes over."""
    words = F.split(c, " ")
    state = F.aggregate(
        F.slice(words, 2, F.lit(2**30)),
        F.struct(F.get(words, F.lit(0)).alias("t"), F.lit(False).alias("full")),
        lambda s, w: F.when(s["full"], s).otherwise(F.struct(F.concat(s["t"], F.lit(" "), w).alias("t"), (F.length(s["t"]) + F.length(w) >= length).alias("full"))),
    )
    return state["t"]


def xml_safe(c: Column) -> Column:
    """Without characters that XML 1.0 does not allow."""
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def unrepeated_lines(c: Column) -> Column:
    """Lines that repeat the line before are left out; leading empty lines too."""
    lines = F.split(c, "\n")
    keep = F.filter(lines, lambda x, i: x != F.when(i == 0, F.lit("")).otherwise(F.get(lines, i - 1)))
    return F.array_join(keep, "\n")


def masked_identifiers(c: Column) -> Column:
    """Social security, employer and alien numbers masked, in this order."""
    x = F.regexp_replace(c, r"\b\d{3}-\d{2}-\d{4}\b", "XXX-XX-XXXX")
    x = F.regexp_replace(x, r"\b\d{2}-\d{7}\b", "XX-XXXXXXX")
    return F.regexp_replace(x, r"\bA\d{8,9}\b", "AXXXXXXXX")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parties(c: Column, separators: tuple[str, ...] = (" v. ", " v ", " vs. ", " vs ")) -> Column:
    """Two parties at the first separator of the list that the name holds; an empty array without one."""
    out = None
    for s in separators:
        at = F.instr(c, s)
        both = F.array(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(s), F.length(c)))
        out = F.when(at > 0, both) if out is None else out.when(at > 0, both)
    return out.otherwise(F.array().cast("array<string>"))


def bankruptcy_parties(c: Column) -> Column:
    """Parties of a bankruptcy caption; the separator is sought in the raw name, the cleaned name is split."""
    clean = c
    for p in (r"\s*\([^)]*\)$", r"\s*<.*$", r"\s*(-BELOW|-ABOVE).*$", r"\s*- Adversary Proceeding.*$"):
        clean = F.regexp_replace(clean, p, "")
    out = F.when(c.rlike(r"(?i)^(in re|in the matter of|unknown case title)"), F.array().cast("array<string>"))
    for s in (" v. ", " v ", " vs. ", " vs ", " and "):
        out = out.when(F.instr(c, s) > 0, F.split(clean, s.replace(".", r"\."), 2))
    return out.otherwise(F.array(clean))


def oxford(items: Column, word: str = "and") -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(items)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.concat(F.get(items, F.lit(0)), F.lit(f" {word} "), F.get(items, F.lit(1))))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(f", {word} "), F.element_at(items, -1)))
    )


def chunks(c: Column, size: int) -> Column:
    """Pieces of ``size`` characters, without overlap."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def natural_key(c: Column, width: int = 12) -> Column:
    """A string that sorts digit runs by value: digits padded to ``width``."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def informative_words(c: Column) -> Column:
    """Distinct words of a case name that tell it apart, sorted."""
    plain = F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(plain, " +", " ")), " "), lambda w: (F.length(w) > 1) & ~w.isin(*COMMON_CAPTION_WORDS))
    return F.array_sort(F.array_distinct(words))


#: Words that stand in many case names.
COMMON_CAPTION_WORDS = ("and", "as", "at", "by", "co", "company", "corp", "corporation", "et", "al", "ex", "for", "from", "in", "inc", "is", "llc", "ltd", "matter", "of", "on", "or", "re", "rel", "state", "states", "the", "to", "united", "us", "usa", "versus", "vs", "with")


def captions_too_different(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Whether two case names share under ``threshold`` of the informative words of the shorter."""
    x, y = informative_words(a), informative_words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1)) < threshold


def highlighted(c: Column, words: list[str], tag: str = "mark") -> Column:
    """Whole words in any letter case wrapped in a tag."""
    safe = [w for w in words if w.isalnum()]
    return F.regexp_replace(c, rf"(?i)\b({'|'.join(safe)})\b", f"<{tag}>$1</{tag}>") if safe else c


def without_tags(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " "))


def us_phone(c: Column) -> Column:
    """"(ddd) ddd-dddd" of the first ten-digit number, or an empty string."""
    bare = F.regexp_replace(c, r"[()\s]+", "")
    g = lambda i: F.regexp_extract(bare, r"(\d{3})[^0-9]{0,2}(\d{3})[^0-9]{0,2}(\d{4})", i)
    return F.when(g(1) == "", "").otherwise(F.concat(F.lit("("), g(1), F.lit(") "), g(2), F.lit("-"), g(3)))


def humanized(n: Column) -> Column:
    """1.2K, 3.4M, 5.6B; below a thousand the number itself."""
    step = lambda d, s: F.concat(F.format_string("%.1f", n / d), F.lit(s))
    return F.when(n >= 1e9, step(1e9, "B")).when(n >= 1e6, step(1e6, "M")).when(n >= 1e3, step(1e3, "K")).otherwise(n.cast("bigint").cast("string"))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two texts."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), F.lit(1))
    x, y = words(a), words(b)
    count = lambda ws, w: F.size(F.filter(ws, lambda v: v == w)).cast("double")
    norm = lambda ws: F.sqrt(F.aggregate(F.array_distinct(ws), F.lit(0.0), lambda s, w: s + count(ws, w) * count(ws, w)))
    dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, w: s + count(x, w) * count(y, w))
    return F.coalesce(dot / F.nullif(norm(x) * norm(y), F.lit(0.0)), F.lit(0.0))
