"""Ranked lexical search with bit-sliced Bloom signatures and exact rescoring.

A document's signature is a Bloom filter over its distinct terms, and over (term, level) for
terms that occur more than once: level l >= 1 is set if the term occurs more than 2^(l-1)
times. Documents of like size share a block, whose signatures are stored as slices: for each
bit position a bitmap over the block's documents. The bitmap of a term and level is the
intersection of its slices; it holds all documents that have it, and some others.

A query's score is a sum of weight times a saturation that rises with the term's frequency.
The weighted sum of its terms' bitmaps at one level, times the step of the saturation from the
highest frequency below that level to the highest within it, added up over the levels, bounds
each document's score from above, since bitmaps only overestimate. The ten documents with the
greatest bounds are scored from their texts; the tenth score is a threshold, and every
document whose bound reaches it is scored from its text. What is left out is provably below.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benthos.llm.text import Words, chunks, mix, utf8
from benthos.session import materialize

_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Bits set for an entry, bits of a filter for each entry at the size class's upper end, and the longest filter.
PROBES, BITS, WIDEST = 6, 16, 1 << 22
#: Documents in a block at most, and bits of all its slices.
BLOCK, BLOCK_BITS = 4096, 1 << 23
#: Distinct terms whose bitmaps are held at once, and characters of queries that travel with a task.
TERMS_AT_ONCE, QUERY_CHARS = 8192, 1 << 24
#: Documents to score that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000


class Terms(Words):
    """Maximal stretches of letters, digits and all other than ASCII, in lower case (A-Z alone)."""

    @staticmethod
    def _breaks() -> np.ndarray:
        return _OUTSIDE


def terms_of(text: str | None) -> list[str]:
    w = Terms(*utf8(pa.array([text], pa.string())))
    return [w.text(i).decode() for i in range(len(w.start))]


def _entries(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    return mix(hashes ^ (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _bit(entry: np.ndarray, probe: int, width: int) -> np.ndarray:
    step = (entry >> np.uint64(32)) | np.uint64(1)
    return ((entry + np.uint64(probe) * step) & np.uint64(width - 1)).astype(np.int64)


def _positions(hashes: np.ndarray, level: int, width: int) -> list[np.ndarray]:
    """The bits of (term, level) in a filter of ``width`` bits, a power of two."""
    h = _entries(hashes, np.full(len(hashes), level))
    return [_bit(h, k, width) for k in range(PROBES)]


class _Counted:
    """Terms of some rows, told apart by their bytes, with the number of each among the query terms."""

    def __init__(self, known: bytes, size: int, data: np.ndarray, off: np.ndarray):
        own = np.frombuffer(known, np.uint8)
        w = Terms(np.concatenate([own, data[off[0] : off[-1]]]), np.concatenate([[0], off - off[0] + len(own)]))
        first, ids = w.distinct()
        slot = np.full(len(first), -1, np.int64)
        slot[ids[:size]] = np.arange(size)
        self.n = np.diff(w.bounds())[1:]
        self.row, self.ids, self.slot, self.hash = w.row[size:] - 1, ids[size:], slot, w.hash[first]

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of the distinct terms of each row, by row."""
        cells, tf = np.unique(self.row * np.int64(len(self.slot)) + self.ids, return_counts=True)
        return *np.divmod(cells, len(self.slot)), tf


def _identity() -> list[Column]:
    """doc_id, text, and a hash of the text, which tells rows with one doc_id (or none) apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")]


INDEX = "width int, doc_ids array<long>, keys array<long>, sizes array<long>, slices binary, held array<long>, filled long, total long"
_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def build_index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Blocks of bit slices over all rows, and per task how many of its documents hold each of ``terms``.

    Rows with slices: ``width`` bitmaps over the documents in ``doc_ids`` (with the text's hash
    in ``keys`` and number of terms in ``sizes``), 2^c entries at most and over half of that in
    each. Rows without: document counts ``held`` of the terms, documents with a term, terms in
    all. Documents without terms are in no block. A task holds one open block per size class.
    """
    known, size = " ".join(terms).encode(), len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list[tuple]] = {}
        held, filled, total = np.zeros(size, np.int64), 0, 0

        def packed(width: int, rows: list[tuple]) -> pa.RecordBatch:
            bits = np.zeros((width, -(-len(rows) // 8) * 8), bool)
            entry = np.concatenate([r[0] for r in rows])
            at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
            for k in range(PROBES):
                bits[_bit(entry, k, width), at] = True
            lists = [pa.array([[r[i] for r in rows]], pa.list_(pa.int64())) for i in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *lists, pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()), pa.array([None], pa.list_(pa.int64())), *[pa.array([None], pa.int64())] * 2], names=_NAMES)

        for batch in batches:
            data, off = utf8(batch.column(1))
            doc_ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in chunks(off):
                c = _Counted(known, size, data, off[lo : hi + 1])
                row, term, tf = c.cells()
                slot = c.slot[term]
                held += np.bincount(slot[slot >= 0], minlength=size)
                filled, total = filled + int((c.n > 0).sum()), total + int(c.n.sum())
                levels = 1 + np.frexp(tf - 1)[1].astype(np.int64)
                first = np.cumsum(levels) - levels
                level = np.arange(int(levels.sum())) - np.repeat(first, levels)
                entry = _entries(np.repeat(c.hash[term], levels), level)
                count = np.bincount(row, weights=levels, minlength=hi - lo).astype(np.int64)
                cut = np.concatenate(([0], np.cumsum(count))).tolist()
                for i in np.flatnonzero(c.n).tolist():
                    width = min(WIDEST, BITS << (int(count[i]) - 1).bit_length())
                    rows = open_blocks.setdefault(width, [])
                    rows.append((entry[cut[i] : cut[i + 1]].copy(), doc_ids[lo + i], keys[lo + i], int(c.n[i])))
                    if len(rows) >= max(8, min(BLOCK, BLOCK_BITS // width)):
                        yield packed(width, open_blocks.pop(width))
        for width, rows in open_blocks.items():
            yield packed(width, rows)
        empty = [pa.array([None], pa.list_(pa.int64()))] * 3
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), *empty, pa.array([None], pa.binary()), pa.array([held.tolist()], pa.list_(pa.int64())), pa.array([filled], pa.int64()), pa.array([total], pa.int64())], names=_NAMES)

    return docs.select(*_identity()).mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Queries:
    """Weighted terms of each item, and what the scores need to know of all documents."""

    terms: list[str]
    items: list[tuple[np.ndarray, np.ndarray]]  # per item: its terms' numbers, weight times repeats
    documents: int
    total: int

    def mass(self, n: np.ndarray) -> np.ndarray:
        """The length factor of documents with n terms, in hundredths."""
        return 100 - 75 + 75 * np.asarray(n, np.int64) * self.documents // max(self.total, 1)

    def groups(self) -> Iterator[tuple[range, np.ndarray]]:
        """Ranges of items with all their terms, so many terms together as bitmaps may be held."""
        lo, seen = 0, np.zeros(0, np.int64)
        for i, (at, _) in enumerate(self.items):
            more = np.union1d(seen, at)
            if len(more) > TERMS_AT_ONCE and i > lo:
                yield range(lo, i), seen
                lo, more = i, at
            seen = np.unique(more)
        yield range(lo, len(self.items)), seen


def saturation(tf: np.ndarray, mass: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * mass)


def upper_bounds(slices: np.ndarray, sizes: np.ndarray, queries: Queries, hashes: np.ndarray) -> np.ndarray:
    """For each item (row) and document of the block (column) a score that the document's does not exceed."""
    width, docs = len(slices), len(sizes)
    mass, most = queries.mass(sizes), int(sizes.max())
    bounds = np.zeros((len(queries.items), docs), np.int64)
    for items, terms in queries.groups():
        held, level, before = None, 0, np.zeros(docs, np.int64)
        while level == 0 or (2 ** (level - 1) < most and held.any()):
            for at in _positions(hashes[terms], level, width):
                held = slices[at] if held is None else held & slices[at]
            now = saturation(np.int64(2**level), mass)
            some = held.any(axis=1)
            bits = np.unpackbits(held, axis=1, count=docs)
            for i in items:
                at, weight = queries.items[i]
                at = np.searchsorted(terms, at)
                there = some[at]
                if there.any():
                    bounds[i] += (weight[there].astype(float) @ bits[at[there]].astype(float)).astype(np.int64) * (now - before)
            before, level = now, level + 1
    return bounds


FOUND = "item int, doc_id long, key long, bound long"


def _search(index: DataFrame, queries: Queries, keep: int | None, least: list[int]) -> DataFrame:
    """(item, doc_id, key, bound): each task's ``keep`` documents with the greatest bounds, or all with bounds from ``least`` up."""
    hashes = Terms(*utf8(pa.array([" ".join(queries.terms)]))).hash
    floor = np.maximum(np.array(least, np.int64), 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries.items]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n else pa.int32()) for n, c in enumerate(cols)], names=["item", "doc_id", "key", "bound"])

        for batch in batches:
            for width, docs, keys, sizes, raw in zip(*(batch.column(n) for n in ("width", "doc_ids", "keys", "sizes", "slices"))):
                docs, keys, sizes = docs.as_py(), keys.as_py(), np.array(sizes.as_py(), np.int64)
                slices = np.frombuffer(raw.as_buffer(), np.uint8).reshape(width.as_py(), -1)
                bounds = upper_bounds(slices, sizes, queries, hashes)
                if keep is None:
                    items, at = np.nonzero(bounds >= floor)
                    if len(items):
                        yield rows([(i, docs[d], keys[d], b) for i, d, b in zip(items.tolist(), at.tolist(), bounds[items, at].tolist())])
                    continue
                for i, own in enumerate(bounds):
                    low = best[i][-1][3] if len(best[i]) == keep else 0
                    at = np.flatnonzero(own > low)
                    if len(at) > keep:
                        at = at[np.argpartition(-own[at], keep - 1)[:keep]]
                    if len(at):
                        more = [(i, docs[d], keys[d], b) for d, b in zip(at.tolist(), own[at].tolist())]
                        best[i] = sorted(best[i] + more, key=lambda r: -r[3])[:keep]
        if keep is not None:
            yield rows([r for own in best for r in own])

    return index.where("slices is not null").select("width", "doc_ids", "keys", "sizes", "slices").mapInArrow(run, FOUND)


def _score(docs: DataFrame, found: DataFrame, queries: Queries) -> DataFrame:
    """(item, doc_id, score) of the documents found, from their whole texts."""
    known, size = " ".join(queries.terms).encode(), len(queries.terms)
    asked = found.groupBy(F.col("doc_id").alias("asked_id"), F.col("key").alias("asked_key")).agg(F.collect_set("item").alias("items"))
    asked = materialize(asked, "lexical-asked")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    rows = docs.select(*_identity()).join(asked, F.col("key").eqNullSafe(F.col("asked_key")) & F.col("doc_id").eqNullSafe(F.col("asked_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            doc_ids, items = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in chunks(off):
                c = _Counted(known, size, data, off[lo : hi + 1])
                mass, slot = queries.mass(c.n), c.slot[c.ids]
                cells, tf = np.unique(c.row[slot >= 0] * np.int64(size) + slot[slot >= 0], return_counts=True)
                cut = np.searchsorted(cells, np.arange(hi - lo + 1) * size)
                out = []
                for r in range(hi - lo):
                    held = np.zeros(size, np.int64)
                    held[cells[cut[r] : cut[r + 1]] - r * size] = tf[cut[r] : cut[r + 1]]
                    for i in items[lo + r]:
                        at, weight = queries.items[i]
                        out.append((i, doc_ids[lo + r], int((weight * saturation(held[at], mass[r])).sum())))
                cols = list(zip(*out)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64() if n else pa.int32()) for n, x in enumerate(cols)], names=["item", "doc_id", "score"])

    return rows.select("doc_id", "text", "items").mapInArrow(run, "item int, doc_id long, score long").where("score > 0")


def _first(rows: DataFrame, by: str, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(by), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _answer(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    spark = docs.sparkSession
    counts = [Counter(terms_of(text)) for _, text in items]
    terms = sorted(set().union(*counts))
    number = {t: k for k, t in enumerate(terms)}
    index = materialize(build_index(docs, terms), "lexical-index")
    stats = index.where("held is not null")
    filled, total = stats.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = dict(stats.select(F.posexplode("held").alias("term", "n")).groupBy("term").agg(F.sum("n")).collect())  # a row per query term
    weight = np.array([math.floor(1000 * math.log((2 * filled + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(terms))], np.int64)
    weighted = []
    for own in counts:
        at = np.array(sorted(number[t] for t in own), np.int64)
        weighted.append((at, weight[at] * np.array([own[terms[k]] for k in at], np.int64)))
    queries = Queries(terms, weighted, filled, total)
    nothing = [0] * len(items)
    scored = _score(docs, _first(_search(index, queries, top, nothing), "bound", top), queries)
    least = dict(_first(scored, "score", top).where(F.col("rank") == top).select("item", "score").collect())  # a row per item
    scored = _score(docs, _search(index, queries, None, [least.get(i, 0) for i in range(len(items))]), queries)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return _first(scored, "score", top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0.

    Terms are maximal stretches of digits, letters and other characters than ASCII, A-Z in lower
    case. Of N documents with terms and L terms in all, a document with n terms has mass
    m = 25 + 75 n N div L; a term held by df documents weighs w = floor(1000 ln((2 N + 2) / (2 df + 1)));
    the score adds up w * (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included.
    Higher scores come first, then smaller doc_ids, null last. Whole texts are read. Null and
    empty texts have no terms: such documents are never found, such items find nothing.
    Repeated documents are ranked each, repeated items answered each; other columns are not
    read. Empty in, empty out. Items are taken in rounds of at most ``QUERY_CHARS`` characters
    or one item, whichever is more; all documents are searched for each.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = 1 + chars // QUERY_CHARS
    answers = []
    for k in range(rounds):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k).orderBy("item_id", "text").collect()]
        if own:
            answers.append(_answer(docs, own, top))
    out = answers[0] if answers else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
