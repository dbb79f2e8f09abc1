"""Evaluation passages that stand in training documents.

Winnowing. Texts are reduced to lower-case letters and digits without spaces,
so case, punctuation, spacing and line breaks do not matter. Of the hashes of
all runs of ``K`` characters the least of each window of ``WINDOW`` runs is
kept, on both sides; every shared span of ``K + WINDOW - 1`` characters
therefore shares a fingerprint. Hits are extended: inside the candidate
document all runs of ``SEED`` characters shared with the item are chained
along nearly equal diagonals, gaps as short as a changed letter or word are
bridged, and the item's words under the one or two best stretches are counted.

The items' fingerprints are a written table and the size of the test set does
not matter: the documents are scanned once, a Bloom filter of fixed size tells
which of their fingerprints may be an item's, and only documents with enough of
them (the least that any item asks for) are written, as a small table of
suspects. Fingerprints are joined on their hash. A pair needs ``GATE`` of the
item's fingerprints, so an item is filed without as many of its most frequent
ones as that leaves over (prefix filter, exact); pairs that meet are counted on
their fingerprint sets, and only pairs past the gate bring text together.

Stock prose is told by the corpus itself: a fingerprint that stands in more
than ``STOCK_SHARE`` of all documents (counted over all of them) is stock for
an item, and doesn't count for it, if fewer than half of these documents hit
``LITERAL`` of the item's fingerprints. An item that leaked widely, or in many
copies, is no stock.

Defined results. NULL, empty and very short texts leak nothing; equal items
are reported each; repeated document ids give one row for each item; an empty
side gives an empty table.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import materialise

K = 16
WINDOW = 12
SEED = 9
SHARE = 0.25
STOCK_SHARE = 0.01
CHUNK = 30_000
#: Bits of the filter that travels to the tasks, whatever the number of items; a fuller filter only lets more suspects through.
BLOOM_BITS = 1 << 24
#: Items that a worker keeps ready.
ITEMS_HELD = 2_000

#: Longest gap bridged in a stretch, largest change of diagonal in it, shortest stretch, least share of a stretch that is shared literally.
GAP, SHIFT, LEAST, SOLID = 34, 16, 40, 0.55
#: Share of an item's fingerprints (stock left out) that must be hit before a document is read closely.
GATE = 0.08
#: A pair counts if SHARE of the words are held and LITERAL of the fingerprints hit; with fewer fingerprints hit (heavy noise) it needs NOISY_SHARE of the words.
LITERAL, NOISY_SHARE = 0.15, 0.36

_DROP = bytes(b for b in range(256) if not (48 <= b <= 57 or 97 <= b <= 122))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def squeeze(text: str) -> bytes:
    """Lower-case letters and digits of a text, accents removed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.lower().encode("ascii", "ignore").translate(None, _DROP)


def run_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` bytes, by doubling."""
    if len(raw) < k:
        return np.zeros(0, np.uint64)
    h, size, out, done = raw.astype(np.uint64), 1, None, 0
    while size <= k:
        if k & size:
            if out is None:
                out, done = h, size
            else:
                n = len(raw) - done - size + 1
                out = (out[:n] * _MUL ^ (h[done : done + n] >> np.uint64(29)) + h[done : done + n]) * _MUL
                done += size
        if size * 2 <= k:
            n = len(h) - size
            h = (h[:n] * _MUL ^ (h[size:] >> np.uint64(29)) + h[size:]) * _MUL
        size *= 2
    return out ^ (out >> np.uint64(32))


def _slide(h: np.ndarray, w: int, op) -> np.ndarray:
    """op over each window of ``w`` neighbours."""
    size = 1
    while size * 2 <= w:
        h = op(h[:-size], h[size:])
        size *= 2
    return op(h[: len(h) - (w - size)], h[w - size :]) if size < w else h


def winnow(h: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Places of the hashes that are least in some window."""
    if len(h) <= w:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    least = _slide(h, w, np.minimum)
    pad = np.zeros(w - 1, h.dtype)
    reach = _slide(np.concatenate([pad, least, pad]), w, np.maximum)
    return np.flatnonzero(reach == h)


class Item:
    """One evaluation item, ready for extension."""

    def __init__(self, text: str):
        parts = [p for p in (squeeze(w) for w in text.split()) if p]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        h = run_hashes(raw, K)
        self.fps = np.unique(h[winnow(h)]).view(np.int64)
        s = run_hashes(raw, SEED)
        order = np.argsort(s, kind="stable")
        self.seeds, self.places = s[order], order.astype(np.int32)
        self.word_at = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        self.words = len(parts)


@lru_cache(maxsize=ITEMS_HELD)
def item_of(text: str) -> Item:
    return Item(text)


def _chunk_hits(raws: list[bytes], first: int, bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of winnowed fingerprints that pass the filter, each once, for texts that together fit the cache."""
    lengths = np.array([len(r) for r in raws])
    ends = np.cumsum(lengths)
    h = run_hashes(np.frombuffer(b"".join(raws), np.uint8), K)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = winnow(h)
    # Windows over a text's ends reach into its neighbours and may miss its own minima there: the runs at its ends are all kept.
    edge = ((ends - lengths)[:, None] + np.arange(WINDOW)).ravel()
    tail = (ends[:, None] - K - np.arange(WINDOW)).ravel()
    at = np.concatenate([at, edge[edge < len(h)], tail[(tail >= 0) & (tail < len(h))]])
    g = h[at]
    maybe = bloom[_bit(g, 0, len(bloom))]
    at, g = at[maybe], g[maybe]
    maybe = bloom[_bit(g, 32, len(bloom))]
    at, g = at[maybe], g[maybe]
    doc = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[np.minimum(doc, len(ends) - 1)]
    g, doc = g[inside].view(np.int64), doc[inside]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new] + first, g[new]


def _bit(g: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return ((g >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)


def hits_of(texts: list[str | None], bloom: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Squeezed texts, and the (text, fingerprint) pairs that pass the filter, by text.

    Texts are hashed many at a time in arrays of about ``CHUNK`` characters; runs across a boundary are left out.
    """
    raws = [squeeze(t) if t else b"" for t in texts]
    found, first, size = [], 0, 0
    for i, r in enumerate(raws):
        size += len(r)
        if size >= CHUNK or i + 1 == len(raws):
            found.append(_chunk_hits(raws[first : i + 1], first, bloom))
            first, size = i + 1, 0
    if not found:
        return raws, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return raws, np.concatenate([d for d, _ in found]), np.concatenate([g for _, g in found])


def _chains(runs: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Runs (document start, item start, document end, item end), by document start, joined to stretches: [q0, q1, p0, p1, shared].

    A run follows the latest stretch that ends near its start in both texts; stretches lie in a list by their document end,
    so those within reach are found whatever their number.
    """
    chains: list[list[int]] = []
    by_end: list[tuple[int, int]] = []  # (document end, number of the stretch), sorted
    for q0, p0, q1, p1 in runs:
        best = None
        for end, n in by_end[bisect_left(by_end, (q0 - GAP, 0)) : bisect_left(by_end, (q0 + SEED + 1, 0))]:
            c = chains[n]
            gq, gp = q0 - c[1], p0 - c[3]
            if -SEED <= gp <= GAP and abs(gq - gp) <= SHIFT and p1 > c[3] and q1 > c[1] and (best is None or n > best):
                best = n
        if best is None:
            best = len(chains)
            chains.append([q0, q1, p0, p1, p1 - p0])
        else:
            c = chains[best]
            del by_end[bisect_left(by_end, (c[1], best))]
            c[4] += p1 - max(p0, c[3])
            c[1], c[3] = q1, p1
        at = (chains[best][1], best)
        by_end.insert(bisect_left(by_end, at), at)
    return chains


def _best_two(good: list[tuple[int, int, int, int]], word_at: np.ndarray) -> int:
    """Most words under one stretch, or under two that follow each other in both texts."""
    spans = [(q0, q1, p0, p1, int(word_at[p0]), int(word_at[p1 - 1])) for q0, q1, p0, p1 in good]
    # Equal spans of the item: copies of a passage differ by place only; what counts of them are the first to end and the last to start.
    kept: dict[tuple[int, int], list] = {}
    for s in spans:
        k = kept.setdefault((s[2], s[3]), [s, s])
        k[0] = min(k[0], s, key=lambda x: x[1])
        k[1] = max(k[1], s, key=lambda x: x[0])
    ends = sorted((k[0] for k in kept.values()), key=lambda s: s[5] - s[4], reverse=True)
    starts = sorted((k[1] for k in kept.values()), key=lambda s: s[5] - s[4], reverse=True)
    most = 0
    for x in ends:
        n = x[5] - x[4] + 1
        most = max(most, n)
        for y in starts:
            m = y[5] - y[4] + 1
            if n + m <= most:
                break
            if y[0] >= x[1] - SEED and y[2] >= x[3] - SEED:
                most = max(most, n + m - max(0, x[5] - max(x[4], y[4]) + 1 if y[4] <= x[5] else 0))
    return most


def held_words(raw: bytes, item: Item) -> int:
    """Words of an item in its one or two best stretches of a squeezed document."""
    doc = run_hashes(np.frombuffer(raw, np.uint8), SEED)
    if not len(doc) or not len(item.seeds):
        return 0
    lo, hi = np.searchsorted(item.seeds, doc, "left"), np.searchsorted(item.seeds, doc, "right")
    cnt = hi - lo
    q = np.repeat(np.arange(len(doc)), cnt)
    p = item.places[np.repeat(lo, cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)]
    if not len(q):
        return 0
    # Straight runs: seeds on one diagonal whose places follow each other.
    order = np.lexsort((q, q - p))
    q, p = q[order], p[order]
    cut = np.flatnonzero((np.diff(q - p) != 0) | (np.diff(q) > SEED + 2)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(q)]]) - 1
    long = p[last] - p[first] >= 3
    first, last = first[long], last[long]
    runs = sorted(zip(q[first].tolist(), p[first].tolist(), (q[last] + SEED).tolist(), (p[last] + SEED).tolist()))
    good = [(q0, q1, p0, p1) for q0, q1, p0, p1, solid in _chains(runs) if p1 - p0 >= LEAST and solid >= SOLID * (p1 - p0)]
    return _best_two(good, item.word_at) if good else 0


def _filter(prints: DataFrame) -> np.ndarray:
    """The Bloom filter of a fingerprint column: words of bits are made in the tasks, at most ``BLOOM_BITS`` / 64 of them come back."""
    mask = F.lit(BLOOM_BITS - 1).cast("bigint")
    bits = prints.select(F.explode(F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseAND(mask))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, words, share, literal) of each document that holds a passage of an item."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("txt"))
    kind = src.schema[0].dataType.simpleString()
    asked = items.select(F.col(f"`{item_key}`").cast("bigint").alias("item"), F.col(f"`{item_text}`").alias("said")).where(F.col("said").rlike(r"\w")).groupBy("item").agg(F.min("said").alias("said"))

    def fingerprints(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = [item_of(t).fps for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["item", "said", "has"])

    known = materialise(
        asked.mapInArrow(fingerprints, "item bigint, said string, has array<bigint>").where(F.size("has") > 0).withColumn("least", F.greatest(F.lit(1), F.ceil(F.size("has") * GATE - 1e-9).cast("int"))), "items"
    )
    prints = known.select("item", "least", F.explode("has").alias("fp"))
    fewest = known.agg(F.min("least")).first()[0]
    if fewest is None:
        return spark.createDataFrame([], f"doc_id {kind}, item_id bigint, words int, share double, literal double")
    sent = spark.sparkContext.broadcast(np.packbits(_filter(prints)))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bloom = np.unpackbits(sent.value).astype(bool)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            raws, doc, fp = hits_of(b.column(1).to_pylist(), bloom)
            n = np.bincount(doc, minlength=len(raws))
            pick = np.flatnonzero(n >= fewest)
            keep = n[doc] >= fewest
            ends = np.concatenate([[0], np.cumsum(n[pick])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + pick), b.column(0).take(pa.array(pick)), pa.array([raws[i] for i in pick.tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(fp[keep]))],
                names=["row", "doc", "raw", "fps"],
            )
            number += len(raws)

    suspects = materialise(src.mapInArrow(scan, f"row bigint, doc {kind}, raw binary, fps array<bigint>"), "suspects")
    seen = materialise(suspects.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("docs")), "fingerprint-counts")
    filed = prints.join(seen, "fp").withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("docs"), "fp")))
    # ``least`` hits needed: without the least - 1 most frequent fingerprints one hit at least is left.
    filed = filed.where("nth >= least").select("item", "fp")
    met = suspects.select("row", F.explode("fps").alias("fp")).join(filed, "fp").select("row", "item").distinct()
    shared = F.array_intersect("fps", "has")
    counted = met.join(suspects.select("row", "fps"), "row").join(known.select("item", "has", "least"), "item").withColumn("hit", shared).where(F.size("hit") >= F.col("least"))
    passed = materialise(counted.select("row", "item", "hit", F.size("has").alias("n")), "pairs")
    # Stock prose, told by fingerprints alone: no text moves for it.
    wide = seen.where(F.col("docs") > STOCK_SHARE * docs.count() + 20)
    holding = passed.where(F.size("hit") >= LITERAL * F.col("n")).select("item", F.explode("hit").alias("fp")).join(wide, "fp").groupBy("item", "fp").agg(F.count("*").alias("held"))
    stock = prints.join(wide, "fp").join(holding, ["item", "fp"], "left").where(2 * F.coalesce("held", F.lit(0)) < F.col("docs")).groupBy("item").agg(F.collect_list("fp").alias("stock"))
    judged = passed.join(stock, "item", "left").withColumn("stock", F.coalesce("stock", F.array().cast("array<bigint>")))
    judged = judged.select("row", "item", (F.size(F.array_except("hit", "stock")) / (F.col("n") - F.size("stock"))).alias("literal")).where(F.col("literal") >= GATE)
    ready = judged.join(suspects.select("row", "doc", "raw"), "row").join(known.select("item", "said"), "item").select("doc", "item", "raw", "said", "literal")

    def extend(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = [item_of(t) for t in b.column(3).to_pylist()]
            held = [held_words(r, i) for r, i in zip(b.column(2).to_pylist(), made)]
            share = [h / i.words for h, i in zip(held, made)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.int32()), pa.array(share), b.column(4)], names=["doc_id", "item_id", "words", "share", "literal"])

    rows = ready.mapInArrow(extend, f"doc_id {kind}, item_id bigint, words int, share double, literal double")
    enough = F.when(F.col("literal") >= LITERAL, F.lit(SHARE)).otherwise(F.lit(NOISY_SHARE))
    return rows.where(F.col("share") >= enough).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("words", "share", "literal")])
