"""Encoding of a corpus with a public byte-level BPE tokenizer.

Each task splits its texts into words by the tokenizer's pattern and keeps the
ids of words it has met. New words of a batch go to DuckDB as token-position
rows: a recursive query joins neighbouring tokens with the merge table and
contracts the leftmost pair of least rank of each word until no pair of the
word is in the table; an ordered aggregation gives the ids. Words longer than
``LONG_WORD`` bytes (runs of one character, encoded blobs) would need as many
rounds as bytes, so those take the same contraction through a heap.

No shuffle and no statistics of the corpus are needed, so the work is one map
over the scan. The words held by a worker are bounded by ``HELD_WORDS``.

Defined results. NULL and empty texts give an empty list. Text that looks like
a special token is ordinary text. Unpaired surrogates cannot occur in Parquet
strings. Any other column is left out, so clashing names do no harm.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_WORDS = 400_000
LONG_WORD = 96

#: The pattern of the byte-level tokenizers, white space as Unicode has it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: least_rank * 1024 + p orders pairs by rank, then place; words have fewer than 1024 bytes here.
_MERGE_SQL = """
WITH RECURSIVE s AS (
    SELECT w, p, tok, FALSE AS done FROM start
    UNION ALL
    SELECT w, p, CASE WHEN p = spot THEN made ELSE tok END AS tok, spot IS NULL AS done
    FROM (
        SELECT w, p, tok,
               min(least_rank * 1024 + p) OVER word % 1024 AS spot,
               made, lag(p) OVER (PARTITION BY w ORDER BY p) AS before
        FROM (
            SELECT a.w, a.p, a.tok, m.made, m.merge_rank AS least_rank
            FROM (SELECT w, p, tok, lead(tok) OVER (PARTITION BY w ORDER BY p) AS nxt FROM s WHERE NOT done) a
            LEFT JOIN merges m ON m.pair = a.tok * 65536 + a.nxt
        )
        WINDOW word AS (PARTITION BY w)
    )
    WHERE spot IS NULL OR before IS NULL OR before <> spot
)
SELECT w, list(tok ORDER BY p) AS ids FROM s WHERE done GROUP BY w
"""


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest goes to U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class ByteBpe:
    """Ids of words under one tokenizer file; one instance lives in each Python worker."""

    held: dict[str, "ByteBpe"] = {}

    def __init__(self, path: str):
        import duckdb
        import pyarrow as pa
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        back = {c: b for b, c in letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = dict(zip(zip(left.tolist(), right.tolist()), zip(range(len(pairs)), made.tolist())))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = pa.table({"pair": left * 65536 + right, "merge_rank": np.arange(len(pairs), dtype=np.int32), "made": made})
        self.con.register("merges_in", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.con.unregister("merges_in")
        self.find = regex.compile(_PATTERN).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.mid: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str) -> "ByteBpe":
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _long(self, raw: bytes) -> tuple[int, ...]:
        """The contraction of one long word: pairs leave a heap by (rank, place)."""
        tok = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(tok)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, tok[i], tok[i + 1], r[1]) for i in range(n - 1) if (r := self.rank.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or tok[i] != a or tok[j] != b:
                continue
            tok[i], alive[j], nxt[i] = made, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := self.rank.get((tok[x], tok[y]))):
                    heapq.heappush(heap, (r[0], x, tok[x], tok[y], r[1]))
        return tuple(t for t, ok in zip(tok, alive) if ok)

    def learn(self, new: list[str]) -> None:
        """Add the ids of words not met before."""
        import pyarrow as pa

        short: list[str] = []
        raws: list[bytes] = []
        for w in new:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) > LONG_WORD:
                self.words[w] = self._long(raw)
            else:
                short.append(w)
                raws.append(raw)
        if not short:
            return
        lengths = np.array([len(r) for r in raws])
        ends = np.cumsum(lengths)
        w = np.repeat(np.arange(len(raws), dtype=np.int32), lengths)
        p = (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int16)
        tok = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)].astype(np.int64)
        self.con.register("start", pa.table({"w": w, "p": p, "tok": tok}))
        got = self.con.sql(_MERGE_SQL).to_arrow_table()
        self.con.unregister("start")
        for at, ids in zip(got["w"].to_pylist(), got["ids"].to_pylist()):
            self.words[short[at]] = tuple(ids)

    def _split(self, texts: list[str]) -> list[list[str]]:
        """Texts cut at single spaces between other characters; such a space begins a word, so each cut is a word's start."""
        import regex

        odd = regex.compile(rf"[{_WS}--[\n ]]", regex.V1).search
        safe = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])").split
        out = []
        for t in texts:
            if "  " in t or "\n " in t or " \n" in t or odd(t):
                out.append(safe(t))
            else:
                out.append(t.split(" "))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch."""
        if len(self.mid) + len(self.words) > HELD_WORDS:
            self.mid.clear()
            self.words.clear()
        parts = self._split([t or "" for t in texts])
        mid = self.mid
        seen: set[str] = set()
        for p in parts:
            seen.update(p[1:])
        fresh = [x for x in seen if x not in mid]
        cut = {x: self.find(" " + x) for x in fresh}
        heads = [self.find(p[0]) for p in parts]
        new = set(chain.from_iterable(cut.values()))
        new.update(chain.from_iterable(heads))
        new = [w for w in new if w not in self.words]
        if new:
            self.learn(new)
        words = self.words
        for x, ws in cut.items():
            mid[x] = tuple(chain.from_iterable([words[w] for w in ws])) if len(ws) != 1 else words[ws[0]]
        offsets = np.zeros(len(parts) + 1, np.int32)
        flat: list[np.ndarray] = []
        for i, (p, h) in enumerate(zip(parts, heads)):
            ids = list(chain.from_iterable([words[w] for w in h]))
            ids.extend(chain.from_iterable(map(mid.__getitem__, p[1:])))
            flat.append(np.array(ids, np.int32))
            offsets[i + 1] = offsets[i] + len(ids)
        return offsets, np.concatenate(flat) if flat else np.zeros(0, np.int32)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists, by an ordered aggregation over (text, position, token bytes)."""
        import pyarrow as pa

        lengths = [len(x) for x in ids]
        rows = pa.table({
            "t": np.repeat(np.arange(len(ids)), lengths),
            "p": np.concatenate([np.arange(n) for n in lengths]) if ids else np.zeros(0, np.int64),
            "h": [self.bytes_of[i].hex() for x in ids for i in x],
        })
        self.con.register("coded", rows)
        got = self.con.execute("SELECT t, string_agg(h, '' ORDER BY p) FROM coded GROUP BY t").fetchall()
        self.con.unregister("coded")
        by = dict(got)
        return [bytes.fromhex(by.get(i, "")).decode("utf-8", "surrogatepass") for i in range(len(ids))]


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, ids) of every row; ``tokenizer`` is the path of a byte-level BPE file that every executor can read."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = ByteBpe.of(tokenizer)
        for b in batches:
            offsets, ids = bpe.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    src = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def roundtrip(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, tokens, same): number of ids and whether decoding them gives the text back."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = ByteBpe.of(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            offsets, ids = bpe.encode(texts)
            back = bpe.decode([ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:])])
            same = [x == y for x, y in zip(texts, back)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(same)], names=[key, "tokens", "same"])

    src = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, tokens int, same boolean")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer: ``QUILLSTONE_TOKENIZERS`` or the usual folder."""
    import os

    return os.path.join(os.environ.get("QUILLSTONE_TOKENIZERS", "/opt/tokenizers"), name)


