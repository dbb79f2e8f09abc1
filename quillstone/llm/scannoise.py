"""Noise in text from scanned pages: found line by line, and repaired.

A noisy channel. Words and word pairs are counted over all texts; a word that
is rare or unknown is read as a misread form of a common word if the scanner's
usual confusions (below, with their probabilities) lead from one to the other.
For every line with such a word Viterbi picks the best sequence over the
candidates of all its words, weighing confusions against the likelihood of
words and pairs. Lines are classed first as running headers and bare page
numbers, which repeat at page breaks, and words broken at line ends are joined
across these before they are looked up, so a fragment is never taken for a
misread word.

The model that travels to the tasks holds words and pairs above a share of all
words counted, which bounds its size whatever the corpus. Texts are read
twice and never shuffled.

Defined results. NULL, empty and blank texts have no noisy lines. Very long
lines are read whole. Repeated rows count once. Text without line breaks has no
header or broken word; its misread words are reported like those of any text,
however long its lines and words are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is printed, what the scan reads, and how often in a hundred misread words.
CONFUSIONS = [
    ("e", "c", 12), ("t", "f", 8), ("a", "@", 8), ("i", "l", 7), ("s", "5", 7), ("o", "0", 7), ("n", "ri", 6), ("d", "cl", 5), ("l", "1", 5), ("u", "ii", 3),
    ("m", "rn", 3), ("n", "u", 3), ("g", "9", 2), ("h", "li", 2), ("ti", "ü", 2), ("y", "v", 2), ("w", "vv", 2), ("b", "6", 1), ("li", "h", 1), ("cl", "d", 1),
    ("rn", "m", 1), ("fi", "ﬁ", 1), ("fl", "ﬂ", 1), ("S", "$", 1), ("B", "8", 1), ("I", "|", 1), ("O", "0", 1), ("S", "5", 1), ("l", "|", 1), ("I", "1", 1),
    ("i", "1", 1), ("I", "l", 1), ("T", "'l'", 1), ("c", "e", 1), ("G", "6", 1), ("l", "i", 1), ("in", "m", 1), ("E", "F", 1), ("Z", "2", 1), ("z", "2", 1), ("i", "|", 1),
]
_LOGP = {}
for _true, _read, _n in CONFUSIONS:
    _LOGP.setdefault(_read, []).append((_true, math.log(_n / 100 * 0.02)))
#: Log-probability that a word is read as printed.
_CLEAN = math.log(0.98)
#: A word or pair enters the model from this count and share of all words on.
WORD_LEAST, WORD_SHARE, PAIR_LEAST, PAIR_SHARE = 3, 1e-7, 5, 1e-6
#: A candidate must be so many times as common as the word read.
RATIO = 6
#: What a running header is at most: one printed line of so many characters.
HEADER_WIDTH = 130
#: Least likeness of two readings of one header.
LIKE = 0.82

_STRIP = " \t\f.,;:!?()[]{}\"“”‘’«»—–"
_EDGE = "'-"
_HYPHENS = "-­¬‐"
_INNER = frozenset("'@$|-_")
_ODD = re.compile(r"[0-9@$|üﬁﬂ]|'l'")
_PAGE_NO = re.compile(r"^[\s\f]*(?:page\s+|p\.\s*)?[\[(*~\-–—\s]*\d{1,4}[\])~\-–—\s]*(?:of\s+\d{1,4})?\s*$|^[\s\f]*\d{1,4}\.\s*$", re.I)


def tokens_of(line: str) -> list[str]:
    """Words of a line without the punctuation around them; numbers and codes are left out later."""
    return [w.strip(_STRIP).strip(_EDGE) if not w.startswith("'l'") else w.strip(_STRIP) for w in line.split()]


def broken_part(line: str) -> str:
    """First part of a word that the end of a line breaks; empty where it breaks none."""
    x = line.rstrip()
    if not x or x[-1] not in _HYPHENS:
        return ""
    x = x[:-1]
    i = len(x)
    while i and (x[i - 1].isalnum() or x[i - 1] in _INNER):
        i -= 1
    while i < len(x) and not x[i].isalpha():
        i += 1
    return x[i:]


class Counts:
    """Counters of one task, handed on when they grow."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.pairs: Counter = Counter()

    def add(self, text: str) -> None:
        raw = text.split()
        self.words.update(raw)
        self.pairs.update(zip(raw, raw[1:]))

    def rows(self) -> Iterator[tuple[str, int]]:
        """(key, count): a word, or two words with a space between."""
        folded: Counter = Counter()
        clean: dict[str, str] = {}
        total = 0
        for w, n in self.words.items():
            total += n
            c = clean[w] = w.strip(_STRIP).strip(_EDGE)
            if c and any(x.isalpha() for x in c):
                folded[c] += n
        yield "", total
        yield from folded.items()
        both: Counter = Counter()
        for (a, b), n in self.pairs.items():
            if b[0].islower() and a.isalpha() and (y := clean[b]).isalpha():
                both[f"{a.lower()} {y}"] += n
        yield from both.items()
        self.words.clear()
        self.pairs.clear()


def count_language(texts: DataFrame) -> dict[str, int]:
    """Counts of words and pairs over all of ``texts`` (one string column), those above the model's bounds."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = Counts()

        def flush():
            rows = list(held.rows())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([n for _, n in rows], pa.int64())], names=["key", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.add(t)
            if len(held.pairs) > 400_000:
                yield flush()
        yield flush()

    from quillstone.session import materialise

    counted = materialise(texts.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "language")
    total = counted.where(F.col("key") == "").agg(F.sum("n")).first()[0] or 0
    word_min, pair_min = max(WORD_LEAST, WORD_SHARE * total), max(PAIR_LEAST, PAIR_SHARE * total)
    is_pair = F.instr("key", " ") > 0
    kept = counted.where((F.col("key") != "") & (F.col("n") >= F.when(is_pair, pair_min).otherwise(word_min)))
    return {r["key"]: r["n"] for r in kept.toLocalIterator()} | {"": total}


class _Suspects(dict):
    """Whether a token, punctuation and all, has a misread source; kept for each token met."""

    def __init__(self, reader: "Reader"):
        super().__init__()
        self.reader = reader

    def __missing__(self, token: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[token] = found = any(self.reader.candidates(w) for w in tokens_of(token))
        return found


class Reader:
    """The language model in a task, with what it has found about each word."""

    def __init__(self, counts: dict[str, int]):
        self.n = counts
        self.total = max(1, counts.get("", 1))
        self.held: dict[str, list[tuple[str, float]]] = {}
        #: A reading changes a word's length by one letter at most, so words longer than this have no source within two readings.
        self.longest = 2 + max((len(w) for w in counts if w.replace("-", "").replace("'", "").isalpha()), default=0)
        self.suspect = _Suspects(self).__getitem__

    def count(self, w: str) -> int:
        """How common a word is; with a capital it may also stand at the start of a sentence."""
        n = self.n.get(w, 0)
        if w[:1].isupper():
            n = max(n, self.n.get(w.lower(), 0), self.n.get(w.capitalize(), 0) if w.isupper() else 0)
        return n

    def _sources(self, w: str, depth: int) -> dict[str, float]:
        """Words that the scan may have read as ``w``, with the log-probability of that."""
        found = {w: 0.0}
        edge = {w: 0.0}
        for _ in range(depth):
            new: dict[str, float] = {}
            for x, lp in edge.items():
                for i in range(len(x)):
                    for k in (1, 2, 3):
                        for true, p in _LOGP.get(x[i : i + k], ()):
                            if i + k <= len(x):
                                y = x[:i] + true + x[i + k :]
                                if y not in found and new.get(y, -1e9) < lp + p:
                                    new[y] = lp + p
            found.update(new)
            edge = new
        del found[w]
        return found

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """Misread sources of a word that are common enough, best first."""
        if w in self.held:
            return self.held[w]
        out: list[tuple[str, float]] = []
        own = self.count(w)
        if 1 < len(w) <= self.longest and any(c.isalpha() for c in w) and "." not in w and own < self.total * 1e-4:
            odd = bool(_ODD.search(w))
            for depth in (1, 2):
                if depth == 2 and own:
                    break
                for y, lp in self._sources(w, depth).items():
                    n = self.count(y)
                    core = [c for c in y if c.isalpha()]
                    if n >= WORD_LEAST and n >= RATIO * own and len(core) >= 2 and y.replace("-", "").replace("'", "").isalpha():
                        out.append((y, lp + math.log(n / self.total)))
                if out:
                    break
            if not out and odd and len(w) > 3 and _MIXED.match(w):
                y = w
                for read, true in (("0", "o"), ("1", "l"), ("5", "s"), ("@", "a"), ("6", "b"), ("8", "b"), ("9", "g"), ("$", "s"), ("|", "i"), ("ü", "ti")):
                    y = y.replace(read, true.upper() if w.isupper() else true)
                out.append((y, -25.0))
        out.sort(key=lambda x: -x[1])
        if len(self.held) > 300_000:
            self.held.clear()
        self.held[w] = out
        return out

    def decode(self, words: list[str]) -> list[str]:
        """Viterbi over the candidates of each word of a line."""
        if not any(self.candidates(w) for w in words):
            return words
        paths: dict[str, tuple[float, list[str]]] = {"": (0.0, [])}
        for w in words:
            options = self.candidates(w)
            # A misread form is itself common in a large corpus: beside a far more common source its own count says little.
            own = self.count(w) if not options else 0.0 if _ODD.search(w) else 0.05 * self.count(w)
            options = [(w, _CLEAN + math.log(max(own, 0.02 if options else 0.5) / self.total)), *options]
            new: dict[str, tuple[float, list[str]]] = {}
            for y, lp in options:
                best = max(((s + self._pair(x, y), p) for x, (s, p) in paths.items()), key=lambda t: t[0])
                new[y] = (best[0] + lp, [*best[1], y])
            paths = new
        return max(paths.values(), key=lambda t: t[0])[1]

    def _pair(self, a: str, b: str) -> float:
        """Gain of a pair over two single words; 0 where it is unknown."""
        n = self.n.get(f"{a.lower()} {b}", 0)
        return min(4.0, max(0.0, math.log(n * self.total / (max(1, self.count(a)) * max(1, self.count(b)))))) if n else 0.0


_MIXED = re.compile(r"^(?=(?:[^0-9]*[0-9]){0,2}[^0-9]*$)(?:[0$5|]?[A-Za-z'|@$ü]*[A-Za-z|][0-9@$|ü]{1,2}[A-Za-z|][A-Za-z'|@$0-9ü]*|[05$|8][A-Za-z'0-9]{3,}|[A-Za-z']{3,}[0-9@$|])$")

_CASE_NO = r"(?:[0-9oOlI]{1,2}[:;])?[0-9oOlI]{2,4}[-–][a-z0-9]{1,5}(?:[-–][0-9oOlI]{2,6})?"
_FORMS = [
    re.compile(r"^(?:n[o0]s?\.?\s+)+[\w:;.\-–]*[0-9][\w:;.\-–]*$", re.I),
    re.compile(r"^c[a@]s[ec]\b.{2,40}\bd[o0]c.{3,8}\b.*p[a@]g[ec]\s+\S+\s+of\s+\S+$", re.I),
    re.compile(r"\|\s{1,4}\S{3,6}\s+\S{6,9}$"),
    re.compile(rf"\S\s{{3,}}(?:N[o0]\.?\s+)?{_CASE_NO}$", re.I),
    re.compile(r"^(?=[^a-z]*$).{3,}\sV\.\s.{3,}$"),
]
_CAPTION = re.compile(r"(?:\s[vV][.,s]{1,2}\s|^[I1l|][nN]\s+[rR][eEcC]\s|^(?:Estate|Matter|State|United States)\b.*\sv\.\s)")
#: What stands before a number that goes with it: a section sign, volume and reporter, a month, a day; before one that ends a sentence, a word of reference too.
_NUMBERED = re.compile(
    r"(?:§|\b\d{1,4}(?:\s+(?:[A-Z][\w']*\.)+)+(?:\s?\d[a-z]{1,2}\.?)?|\b(?:No|Nos|January|February|March|April|May|June|July|August|September|October|November|December)\.?|\d,)$"
)
_REFERRED = re.compile(r"\b(?:paragraph|exhibit|page|count|section|part|rule|chapter|volume|document|number)$", re.I)
_PAGED = re.compile(r"^(\d{1,4})\s{2,}(\S.*)$|^(\S.*\S)\s{2,}(\d{1,4})$")


def _bare(line: str) -> tuple[str, bool]:
    """A line without form feed and the page number at either end, and whether it had one."""
    x = line.strip(" \t\f\r")
    if m := _PAGED.match(x):
        return (m.group(2) or m.group(3)).strip(), True
    return x, False


def _like(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or 2 * min(len(a), len(b)) < LIKE * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b, False)
    return m.real_quick_ratio() >= LIKE and m.quick_ratio() >= LIKE and m.ratio() >= LIKE


def class_lines(lines: list[str]) -> list[str]:
    """'header', 'page_no', 'blank' or 'text' for each line."""
    kinds = ["blank" if not x.strip() else "text" for x in lines]
    filled = [i for i, k in enumerate(kinds) if k == "text"]
    for at, i in enumerate(filled):
        if _PAGE_NO.match(lines[i]):
            x = lines[i].strip()
            # a plain number in the middle or at the end of a sentence is the rest of a wrapped line
            before = lines[filled[at - 1]].rstrip() if at else ""
            if x.rstrip(".").isdigit() and _NUMBERED.search(before):
                continue
            if x.endswith(".") and (_REFERRED.search(before) or i + 1 == len(lines) or kinds[i + 1] == "blank"):
                continue  # a number that ends a paragraph
            kinds[i] = "page_no"
    strong: list[tuple[int, str]] = []
    weak: list[tuple[int, str]] = []
    for at, i in enumerate(filled):
        if kinds[i] != "text" or len(lines[i]) > HEADER_WIDTH:
            continue
        x, paged = _bare(lines[i])
        break_here = at == 0 or lines[i].startswith("\f") or kinds[filled[at - 1]] == "page_no" or paged
        near = break_here or at + 1 == len(filled) or kinds[filled[at + 1]] == "page_no"
        if len(x) < 3:
            continue
        if any(f.search(x) for f in _FORMS[1:]) or (_FORMS[0].search(x)) or _like(x.lower(), "opinion of the court"):
            strong.append((i, x))
        elif break_here and _CAPTION.search(x) and not x.endswith((".",)) or paged and (_CAPTION.search(x) or x.isupper()):
            (strong if paged or lines[i].startswith("\f") or at and kinds[filled[at - 1]] == "page_no" else weak).append((i, x))
        elif near:
            weak.append((i, x))
    for i, _ in strong:
        kinds[i] = "header"
    known = [x for _, x in strong]
    for n, (i, x) in enumerate(weak):
        if any(_like(x, y) for y in known) or (_CAPTION.search(x) or lines[i].startswith("\f")) and any(_like(x, y) for j, y in weak if j != i):
            kinds[i] = "header"
    return kinds


def noisy_lines(text: str, reader: Reader) -> list[tuple[int, str]]:
    """(line number, kind) of every noisy line of a text."""
    lines = text.split("\n")
    out: list[tuple[int, str]] = []
    kinds = class_lines(lines) if len(lines) > 1 else ["text"]
    fragment = ""  # first part of a word broken at the end of the text line before
    rest = [i for i, k in enumerate(kinds) if k == "text"]
    follows = dict(zip(rest, rest[1:]))
    for i, line in enumerate(lines):
        kind = kinds[i]
        if kind in ("header", "page_no"):
            out.append((i + 1, kind))
        if kind != "text":
            continue
        m = broken_part(line)
        if not m and not any(map(reader.suspect, line.split())):
            fragment = ""
            continue
        check = tokens_of(line)
        if fragment and check:
            check[0] = ""  # looked up with the line it began on
        fragment = ""
        if m and i in follows:
            nxt = lines[follows[i]].split()
            second = nxt[0].strip(_STRIP).strip(_EDGE) if nxt else ""
            if second and (second[0].islower() or not second[0].isalpha() or m.isupper()):
                first = m
                whole, compound = first + second, f"{first}-{second}"
                fragment = first
                if check:
                    check[-1] = ""
                plain = line.rstrip()[-1] in "-‐"
                n_whole, n_compound = _known(reader, whole), _known(reader, compound)
                if n_whole >= n_compound and not (n_whole == 0 and plain and _known(reader, first) and _known(reader, second) and _PREFIX.fullmatch(first)):
                    out.append((i + 1, "hyphen"))
                if n_whole == 0 and n_compound == 0 and reader.candidates(whole):
                    y = reader.decode([*check[-2:-1], whole, *tokens_of(" ".join(nxt[1:2]))])[len(check[-2:-1])]
                    if y != whole:
                        # the misread letter lies in the part that differs
                        spot = i if not y.lower().startswith(first.lower()) else follows[i]
                        out.append((spot + 1, "char"))
        if any(reader.candidates(w) for w in check if w):
            if reader.decode(check) != check:
                out.append((i + 1, "char"))
    return sorted(set(out))


_PREFIX = re.compile(r"(?:cross|post|pre|non|well|self|co|anti|long|short|hand|take|half|high|low|over|under|counter|ex|mid|multi|semi)", re.I)


def _known(reader: Reader, w: str) -> int:
    """Count of a word, allowing for misread letters."""
    n = reader.count(w)
    if n == 0 and (got := reader.candidates(w)) and got[0][1] > -25:
        n = reader.count(got[0][0])
    return n


def repair(text: str, reader: Reader) -> str:
    """Continuous paragraphs: headers and page numbers out, broken words joined, misread words replaced by the best reading."""
    lines = text.split("\n")
    kinds = class_lines(lines) if len(lines) > 1 else ["text"]
    broken = {i for i, k in ((n - 1, k) for n, k in noisy_lines(text, reader)) if k == "hyphen"}
    paragraphs: list[str] = [""]
    join = False
    for i, line in enumerate(lines):
        if kinds[i] == "blank":
            if not join and paragraphs[-1] and paragraphs[-1].rstrip()[-1:] in ".?!:\"”)":
                paragraphs.append("")
            continue
        if kinds[i] != "text":
            continue
        x = line.strip()
        last = bool(broken_part(line)) and i != len(lines) - 1
        x = re.sub(r"[-­¬‐]\s*$", "" if i in broken else "-", x) if last else x
        paragraphs[-1] += x if join or not paragraphs[-1] else " " + x
        join = last
    out = []
    for p in paragraphs:
        if p:
            raw = p.split()
            words = tokens_of(p)
            if any(reader.candidates(w) for w in words if w):
                raw = [r.replace(a, b) if a != b and a else r for r, a, b in zip(raw, words, reader.decode(words))]
            p = " ".join(raw)
        if p:
            out.append(p)
    return "\n\n".join(out)


_readers: list[tuple[int, Reader]] = []


def _reader(counts) -> Reader:
    if not _readers or _readers[0][0] != counts.id:
        _readers[:] = [(counts.id, Reader(counts.value))]
    return _readers[0][1]


class _Sent:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast.id if hasattr(broadcast, "id") else id(broadcast)

    @property
    def value(self):
        return self.broadcast.value


def find_noise(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(src, row_id, line_no, noise_kind) over several (table, id column, text column)."""
    parts = [df.select(F.lit(src).alias("src"), F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("t")).where(F.col("t").rlike(r"\S")) for src, (df, key, text) in sources.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sc = rows.sparkSession.sparkContext
    counts = _Sent(sc.broadcast(count_language(rows.select("t"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = _reader(counts)
        for b in batches:
            at, no, kind = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for n, k in noisy_lines(t, reader):
                    at.append(i)
                    no.append(n)
                    kind.append(k)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(no, pa.int32()), pa.array(kind, pa.string())], names=["src", "row_id", "line_no", "noise_kind"])

    return rows.mapInArrow(run, "src string, row_id bigint, line_no int, noise_kind string").dropDuplicates()


def repair_sources(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(src, row_id, repaired) over several (table, id column, text column), by the language of all: each text as continuous paragraphs; NULL stays NULL."""
    parts = [df.select(F.lit(src).alias("src"), F.col(f"`{key}`").alias("row_id"), F.col(f"`{text}`").alias("t")) for src, (df, key, text) in sources.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = _Sent(rows.sparkSession.sparkContext.broadcast(count_language(rows.select("t"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = _reader(counts)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else repair(t, reader) for t in b.column(2).to_pylist()], pa.string())], names=["src", "row_id", "repaired"])

    return rows.mapInArrow(run, f"src string, row_id {rows.schema[1].dataType.simpleString()}, repaired string")


def repair_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, repaired) of one table."""
    return repair_sources({"": (df, key, text)}).drop("src")
