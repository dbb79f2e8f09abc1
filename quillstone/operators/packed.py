"""Several values packed in one field, split into one value per row.

A finite-state tokenizer walks each field once. Its state is the open quote
(or none) and the nesting depth of brackets; a backslash escapes the next
character. Delimiters count only outside quotes and at the depth of the list.

Which delimiters part a field is decided from what stands outside quotes:

* ``; | / TAB LF CR``, ``&`` and the word ``and`` always part values;
* a comma parts values only where none of ``; | / TAB LF CR`` does, or next
  to a quoted value; else it belongs to the value ("Last, First");
* a generational suffix after a comma belongs to the value before it.

Defined results. NULL, empty and blank fields give no row; empty values between
delimiters are dropped and positions stay without gaps; an unclosed quote is
taken as a plain character; equal values keep their own positions. Only the
named key columns are carried, so clashing input columns do no harm.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRONG = ";|/\t\n\r"
#: Closing mark of each quote that opens a value.
_QUOTES = {'"': '"', "“": "”", "'": "'", "‘": "’", "«": "»"}
_OPEN, _CLOSE = "[({", "])}"
_SUFFIX = re.compile(r"(?:jr|sr|ii|iii|iv|2nd|3rd)\.?", re.I)
_AND = re.compile(r"and\b", re.I)
_PLAIN = re.compile(r"[^\\;|/\t\n\r,&\"“”'‘’«»\[\](){}aA]+")


def _closes(text: str, start: int, mark: str) -> int:
    """Index of the mark that closes a quote opened before ``start``; -1 if none does.

    A closing mark must be followed by the end, white space, a bracket or a delimiter, so an apostrophe in a name isn't one.
    """
    i = start
    while (i := text.find(mark, i)) >= 0:
        if text[i - 1] != "\\" and (i + 1 == len(text) or text[i + 1] in " ,&])}" + _STRONG):
            return i
        i += 1
    return -1


def _scan(text: str) -> tuple[str, list[tuple[str, str, bool, int, int]]]:
    """The field inside its bracket, and its tokens (value, delimiter after it, quoted?, where it starts and ends)."""
    text = text.strip()
    if text[:1] in tuple(_OPEN) and text[-1:] == _CLOSE[_OPEN.index(text[0])]:
        text = text[1:-1].strip()
    out: list[tuple[str, str, bool, int, int]] = []
    buf: list[str] = []
    quoted, depth, i, n, begun = False, 0, 0, len(text), 0

    def end(delim: str, width: int = 1) -> None:
        nonlocal quoted, begun
        out.append(("".join(buf).strip(), delim, quoted, begun, i))
        buf.clear()
        quoted, begun = False, i + width

    while i < n:
        c = text[i]
        if m := _PLAIN.match(text, i):
            buf.append(m.group())
            i = m.end()
        elif c == "\\" and i + 1 < n:
            buf.append(text[i + 1])
            i += 2
        elif c in _QUOTES and not "".join(buf).strip() and (j := _closes(text, i + 1, _QUOTES[c])) > 0:
            buf.append(re.sub(r"\\(.)", r"\1", text[i + 1 : j]))
            quoted = True
            i = j + 1
        elif c in _OPEN:
            depth += 1
            buf.append(c)
            i += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
            buf.append(c)
            i += 1
        elif depth == 0 and (c in _STRONG or c in ",&"):
            end("strong" if c in _STRONG else c)
            i += 1
        elif depth == 0 and c in "aA" and (i == 0 or text[i - 1].isspace()) and (m := _AND.match(text, i)) and (m.end() == n or text[m.end()].isspace()):
            end("&", m.end() - i)
            i = m.end()
        else:
            buf.append(c)
            i += 1
    end("")
    return text, out


def split_packed(text: str | None) -> list[str]:
    """The values of one field, in order."""
    if text is None or not text.strip():
        return []
    text, tokens = _scan(text)
    strong = any(t[1] == "strong" for t in tokens)
    values: list[str] = []
    before = ""
    glue = False  # the token before ended in a comma that belongs to its value
    before_quoted = False
    start = 0  # of the last value
    for value, delim, quoted, a, z in tokens:
        if value:
            suffix = bool(_SUFFIX.fullmatch(value)) and not quoted
            if values and not quoted and (suffix and before != "strong" or glue and not before_quoted):
                values[-1] = f"{values[-1]}, {value}" if before_quoted else text[start:z].strip()  # as typed, comma and all
            else:
                values.append(value)
                start = a
            before_quoted = quoted
            glue, before = delim == "," and strong, delim
        elif delim != ",":
            glue, before = False, delim
    return values


def explode_packed(df: DataFrame, column: str, keys: list[str], value: str = "value", pos: str = "pos", least: int = 1) -> DataFrame:
    """Rows (keys..., pos, value) of every field of ``column`` with at least ``least`` values.

    Fields without any delimiter, quote or bracket never leave the JVM.
    """
    cuts = r"[;|/\t\n\r,&\"“”'‘’«»\[\](){}\\]|(?i:\band\b)"

    @F.pandas_udf("array<string>")
    def tokenise(fields: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        out = []
        for x in fields:
            if x is None:
                out.append(None)
                continue
            if x not in known:
                known[x] = split_packed(x)
            out.append(known[x])
        return pd.Series(out)

    src = df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(f"`{column}`").alias("__field"))
    src = src.where(F.col("__field").rlike(r"\S"))
    packed = src.where(F.col("__field").rlike(cuts)).withColumn("__values", tokenise("__field"))
    if least <= 1:
        plain = src.where(~F.col("__field").rlike(cuts)).withColumn("__values", F.array(F.regexp_replace("__field", r"^\s+|\s+$", "")))
        packed = packed.unionByName(plain)
    return (
        packed.where(F.size("__values") >= least)
        .select(*[f"__k{i}" for i in range(len(keys))], F.posexplode("__values").alias("__p", "__v"))
        .select(
            *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)],
            (F.col("__p") + 1).cast("int").alias(pos),
            F.col("__v").alias(value),
        )
    )
