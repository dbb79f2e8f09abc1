"""The query language: checks, clean-up, and a parser that compiles a query to a Column.

Grammar: terms, "phrases", "phrases"~n, prefix*, single?character, field:term,
field:"phrase", field:(a OR b), parentheses, AND, OR, NOT; terms side by side
are joined by AND.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.operators.ranking import tokens


class QueryError(ValueError):
    """A query that is not accepted."""


def has_costly_wildcard(q: str) -> bool:
    """A leading *, a prefix of one or two letters with *, or a root mark before one or two letters."""
    return any(w.startswith("*") and len(w) > 1 or re.fullmatch(r"\w{1,2}\*", w) or re.fullmatch(r"![^\s]{1,2}", w) for w in q.split())


def unbalanced_parens(q: str) -> bool:
    return q.count("(") != q.count(")")


def unbalanced_quotes(q: str) -> bool:
    return sum(q.count(x) for x in '"“”') % 2 == 1


def has_proximity_token(q: str) -> bool:
    return bool(re.search(r"/[sp](?!\w)", q))


def repaired(q: str) -> str:
    """The query with its last surplus parentheses and its last odd quote taken out."""
    q = q.replace("“", '"').replace("”", '"')
    while (surplus := q.count("(") - q.count(")")) != 0:
        at = q.rfind("(" if surplus > 0 else ")")
        q = q[:at] + q[at + 1 :]
    if q.count('"') % 2:
        at = q.rfind('"')
        q = q[:at] + q[at + 1 :]
    return q


def connectors(q: str) -> str:
    """Foreign connectors in this language: % is NOT, & is AND, !root is root*, a star inside a word is one character."""
    q = q.replace("“", '"').replace("”", '"').replace(" % ", " NOT ").replace(" & ", " AND ")
    q = re.sub(r"(?:(?<=\s)|^)!([A-Za-z]+)", r"\1*", q)
    return re.sub(r"\*(?=\w)", "?", q)


def with_child_courts(q: str, children: dict[str, list[str]]) -> str:
    """court_id:x and court_id:(x OR y) with the courts below them added."""

    def more(m: re.Match) -> str:
        ids = re.findall(r"\w+", m.group(1).replace(" OR ", " "))
        every = list(dict.fromkeys([*ids, *(k for i in ids for k in children.get(i, []))]))
        return f"court_id:({' OR '.join(every)})" if len(every) > 1 else f"court_id:{every[0]}"

    return re.sub(r"court_id:(\w+|\(\w+(?:\sOR\s\w+)*\))", more, q)


def cleaned(q: str, children: dict[str, list[str]] | None = None) -> str:
    """Connectors replaced; numbers as phrases; docket numbers as a search of their field with a slop of one."""
    if has_costly_wildcard(q):
        raise QueryError("wildcard")
    q = connectors(q)
    out = []
    for part in re.split(r'("[^"]*"(?:~\d+)?|\s+|[()])', q):
        if re.fullmatch(r"(?:\d:)?\d\d-[A-Za-z]{1,5}-\d+", part):
            part = f'docket_number:"{part}"~1'
        elif re.fullmatch(r"\d[\d\-–.,]*", part):
            part = f'"{part}"'
        out.append(part)
    q = "".join(out)
    return with_child_courts(q, children) if children else q


_LEX = re.compile(r'\s*(?:(?P<field>[A-Za-z_]\w*):(?=["(\w])|(?P<phrase>"(?P<words>[^"]*)"(?:~(?P<slop>\d+))?)|(?P<open>\()|(?P<close>\))|(?P<word>[^\s()":]+))')


def parse(q: str) -> tuple:
    """The query as nested tuples: ("and", a, b), ("or", a, b), ("not", a), ("term", field, word), ("phrase", field, words, slop)."""
    if unbalanced_parens(q):
        raise QueryError("parentheses")
    if unbalanced_quotes(q):
        raise QueryError("quotes")
    if has_proximity_token(q):
        raise QueryError("proximity token")
    lex: list[tuple[str, str, str]] = []
    at, q = 0, q.replace("“", '"').replace("”", '"').strip()
    while at < len(q):
        m = _LEX.match(q, at)
        if not m or m.end() == at:
            raise QueryError(q[at:])
        kind = next(k for k in ("field", "phrase", "open", "close", "word") if m[k] is not None)
        lex.append((kind, m["words"] if kind == "phrase" else m[kind], m["slop"] or "0"))
        at = m.end()
    i = 0

    def peek() -> tuple[str, str, str]:
        return lex[i] if i < len(lex) else ("end", "", "0")

    def either(field: str | None) -> tuple:
        nonlocal i
        left = every(field)
        while peek()[:2] == ("word", "OR"):
            i += 1
            left = ("or", left, every(field))
        return left

    def every(field: str | None) -> tuple:
        nonlocal i
        left = single(field)
        while True:
            kind, text, _ = peek()
            if kind in ("end", "close") or (kind, text) == ("word", "OR"):
                return left
            if (kind, text) == ("word", "AND"):
                i += 1
            left = ("and", left, single(field))

    def single(field: str | None) -> tuple:
        nonlocal i
        kind, text, slop = peek()
        i += 1
        if kind == "end":
            raise QueryError("nothing follows an operator")
        if (kind, text) == ("word", "NOT"):
            return ("not", single(field))
        if kind == "field":
            return single(text)
        if kind == "open":
            inner = either(field)
            i += 1
            return inner
        if kind == "phrase":
            return ("phrase", field, tuple(re.findall(r"[^\W]+", text.lower())), int(slop))
        if kind == "word":
            return ("term", field, text.lower())
        raise QueryError(text)

    if not lex:
        raise QueryError("empty")
    tree = either(None)
    if i < len(lex):
        raise QueryError("unexpected )")
    return tree


def compile_query(tree: tuple, default: list[str], keywords: tuple[str, ...] = ()) -> Column:
    """A predicate over text columns; ``keywords`` are compared whole."""
    op = tree[0]
    if op == "and":
        return compile_query(tree[1], default, keywords) & compile_query(tree[2], default, keywords)
    if op == "or":
        return compile_query(tree[1], default, keywords) | compile_query(tree[2], default, keywords)
    if op == "not":
        return ~F.coalesce(compile_query(tree[1], default, keywords), F.lit(False))
    fields = [tree[1]] if tree[1] else default
    out = None
    for f in fields:
        one = _phrase(f, tree[2], tree[3], keywords) if op == "phrase" else _term(f, tree[2], keywords)
        out = one if out is None else out | one
    return F.coalesce(out, F.lit(False))


def _term(field: str, word: str, keywords: tuple[str, ...]) -> Column:
    if field in keywords:
        return F.lower(F.col(field)) == word
    t = tokens(F.col(field))
    if "*" in word or "?" in word:
        p = "^" + re.escape(word).replace(r"\*", ".*").replace(r"\?", ".") + "$"
        return F.exists(t, lambda x: x.rlike(p))
    parts = re.findall(r"\w+", word)
    return F.array_contains(t, parts[0]) if len(parts) == 1 else _phrase(field, tuple(parts), 0, keywords)


def _phrase(field: str, words: tuple[str, ...], slop: int, keywords: tuple[str, ...]) -> Column:
    if field in keywords:
        return F.lower(F.col(field)) == " ".join(words)
    gap = r"[^\p{L}\p{N}_]+" + (rf"(?:[\p{{L}}\p{{N}}_]+[^\p{{L}}\p{{N}}_]+){{0,{slop}}}" if slop else "")
    p = r"(?<![\p{L}\p{N}_])" + gap.join(re.escape(w) for w in words) + r"(?![\p{L}\p{N}_])"
    return F.lower(F.col(field)).rlike(p)
