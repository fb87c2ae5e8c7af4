"""Bigram language model by deleted interpolation, counted over the whole corpus.

p(w | u) = a(b) c(u,w)/c(u) + d(b) c(w)/N + e(b) / (V + 1), with weights by bucket b of the
context's count c(u): one bucket for each count up to four, then one per power of two. The
weights come from expectation-maximisation on held-out counts: one training document in
``held_out`` is deleted from the counts, and its tokens are scored with what is left. The
scores themselves use the counts of all training documents.

The counts do not fit one machine, so nothing is broadcast. Tasks read blocks of documents,
reduce them to distinct words and bigrams (64-bit hashes) with counts, and deal these by key
range. Owners of a range add up and send each block the totals of the keys it asked for.
Blocks then hold, for each token in place, c(w) and c(u,w) and the held-out documents' share
of both, which is all that the weights and the scores need. Keys and counts travel as sorted,
compressed arrays, not as rows. The documents are read twice; a block that differs when it is
read again is an error, never a wrong count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.llm.text import Words, chunks, combine, mix, release_memory, releasing, utf8
from benthos.session import materialize

END, START = mix(np.array([0xE0D], np.uint64))[0], mix(np.array([0x57A27], np.uint64))[0]


@dataclass(frozen=True)
class LmSpec:
    """block_tokens: tokens that a task turns into distinct keys at a time; rounds: of expectation-maximisation;
    held_out: one training document in so many, picked by hash of doc_id, teaches the weights."""

    block_tokens: int = 2_000_000
    rounds: int = 200
    held_out: int = 10


def _squeeze(x: np.ndarray, delta: bool = False) -> bytes:
    """Bytes of an integer array, laid out by significance, compressed; delta for sorted arrays."""
    import zstandard

    if delta and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _expand(b: bytes, kind: type, delta: bool = False) -> np.ndarray:
    import zstandard

    raw, size = zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 33) if b else b"", np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if delta else x


def _bigrams(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; ends: index after each document's last token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.concatenate(([0], ends[:-1]))] = START
    return combine(mix(before + np.uint64(0x632BE59BD9B4E019)), h)  # the pair's order counts


def _blocks(batches: Iterator[pa.RecordBatch], spec: LmSpec) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(block, doc_ids, uses, tokens of each document, token hashes, check) of at least block_tokens, the last excepted.

    A use is 0 for a document that is only scored, 1 for one that is learnt from and 2 for one
    that also teaches the weights; the check is a sum over what the block holds.
    """
    number = TaskContext.get().partitionId() << 24
    held, tokens = [], 0

    def done() -> tuple:
        ids, *rest = zip(*held)
        use, size, h = (np.concatenate(x) for x in rest)
        return number, pa.concat_arrays(ids), use, size, h, zlib.crc32(h.tobytes(), zlib.crc32(use.tobytes(), zlib.crc32(size.astype(np.int64).tobytes())))

    for batch in batches:
        data, off = utf8(batch.column(1))
        use = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
        for lo, hi in chunks(off):
            w = Words(data, off[lo : hi + 1])
            size = np.diff(w.bounds())
            h = np.full(len(w.hash) + len(size), END, np.uint64)
            h[np.arange(len(w.hash)) + w.row] = w.hash
            held.append((batch.column(0).slice(lo, hi - lo), use[lo:hi], size + 1, h))
            tokens += len(h)
            if tokens >= spec.block_tokens:
                yield done()
                number, held, tokens = number + 1, [], 0
    if held:
        yield done()


KEYS = "kind int, bucket int, block long, check long, keys binary, counts binary, held binary"
SEQS = "block long, check long, doc_ids binary, uses binary, sizes binary, words binary, at binary"
COUNTS = "kind int, bucket int, block long, check long, counts binary, held binary, tokens long, held_tokens long, types long"
TOKENS = "block long, doc_ids binary, uses binary, sizes binary, c_word binary, c_pair binary, h_word binary, h_pair binary"


def _to_arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def count_tokens(docs: DataFrame, train: Column, spec: LmSpec = LmSpec()) -> tuple[DataFrame, int, int, int]:
    """Per block of documents: each token's c(w) and c(u,w) in training, and their held-out part; N tokens; held-out tokens; V distinct."""
    teaches = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(6)), F.lit(spec.held_out)) == 0, F.lit(False))
    use = F.when(~F.coalesce(train, F.lit(True)), 0).when(teaches, 2).otherwise(1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), use.alias("use"))
    ranges = max(16, 2 * docs.rdd.getNumPartitions())  # follows the size of the input

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, uses, sizes, h, check in _blocks(batches, spec):
            use = np.repeat(uses, sizes)
            for kind, x in ((0, h), (1, _bigrams(h, np.cumsum(sizes)))):
                distinct, back = np.unique(x, return_inverse=True)
                count, held = (np.bincount(back[use >= k], minlength=len(distinct)).astype(np.uint32) for k in (1, 2))
                owner = ((distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cut = np.searchsorted(owner, np.arange(ranges + 1).astype(np.uint64))
                yield _to_arrow([(kind, r, block, check, _squeeze(distinct[a:z], True), _squeeze(count[a:z]), _squeeze(held[a:z])) for r, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if z > a], KEYS)

    def total(group: pd.DataFrame) -> pd.DataFrame:
        asked = [_expand(b, np.uint64, True) for b in group["keys"]]
        distinct, back = np.unique(np.concatenate(asked), return_inverse=True)
        count, held = (np.bincount(back, np.concatenate([_expand(b, np.uint32) for b in group[c]])).astype(np.uint64) for c in ("counts", "held"))
        cut = np.cumsum([0, *map(len, asked)])
        out = group[["kind", "bucket", "block", "check"]].copy()
        for name, x in (("counts", count), ("held", held)):
            out[name] = [_squeeze(x[back[a:z]]) for a, z in zip(cut[:-1], cut[1:])]
        sums = [int(count.sum()), int(held.sum()), int((count > 0).sum())]
        for name, x in zip(("tokens", "held_tokens", "types"), sums):
            out[name] = [x] + [0] * (len(out) - 1)  # once per range
        del asked, distinct, back, count, held
        release_memory()
        return out

    # dealt by number, so that tasks stay small however large the shuffle is
    pieces = docs.mapInArrow(releasing(keys), KEYS).repartition(2 * ranges, "kind", "bucket")
    totals = materialize(pieces.groupBy("kind", "bucket").applyInPandas(total, COUNTS), "lm-totals")
    n, n_held, v = totals.where("kind = 0").agg(F.sum("tokens"), F.sum("held_tokens"), F.sum("types")).first()

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, uses, sizes, h, check in _blocks(batches, spec):
            words, at = np.unique(h, return_inverse=True)
            yield _to_arrow([(block, check, _ids_out(ids), uses.tobytes(), _squeeze(sizes.astype(np.int64)), _squeeze(words, True), _squeeze(at.astype(np.uint32)))], SEQS)

    def place(seq: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if len(seq) != 1 or (got["check"] != seq["check"].iloc[0]).any() or not len(got):
            raise ValueError("the documents came in another order when they were read again; write them out first")
        row = seq.iloc[0]
        words, at, sizes = _expand(row["words"], np.uint64, True), _expand(row["at"], np.uint32), _expand(row["sizes"], np.int64)
        got = got.sort_values("bucket")
        of = {(k, c): np.concatenate([_expand(b, np.uint64) for b in g[c]]) for k, g in got.groupby("kind") for c in ("counts", "held")}
        _, back = np.unique(_bigrams(words[at], np.cumsum(sizes)), return_inverse=True)
        made = [_squeeze(of[kind, c][where]) for c in ("counts", "held") for kind, where in ((0, at), (1, back))]
        del words, at, of, back
        release_memory()
        return pd.DataFrame([(row["block"], row["doc_ids"], row["uses"], row["sizes"], *made)], columns=[f.split()[0] for f in TOKENS.split(", ")])

    placed = docs.mapInArrow(releasing(sequences), SEQS).groupBy("block").cogroup(totals.select("kind", "bucket", "block", "check", "counts", "held").groupBy("block")).applyInPandas(place, TOKENS)
    return materialize(placed, "lm-tokens"), int(n or 0), int(n_held or 0), int(v or 0)


def _ids_out(ids: pa.Array) -> bytes:
    """doc_ids with their nulls: the null mask, then the values."""
    return np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes() + ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()


def _ids_in(b: bytes) -> pa.Array:
    n = next(k for k in range(len(b) // 8, -1, -1) if 8 * k + -(-k // 8) == len(b))
    mask = np.unpackbits(np.frombuffer(b[: len(b) - 8 * n], np.uint8), count=n).astype(bool)
    return pa.array(np.frombuffer(b[len(b) - 8 * n :], np.int64), mask=mask)


def _parts(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of a block: sizes, uses, and per token c(w), c(u), c(u,w) in training and in its held-out part."""
    sizes, uses = _expand(row["sizes"], np.int64), np.frombuffer(row["uses"], np.uint8)
    ends = np.cumsum(sizes)
    found = []
    for kind in "ch":
        word, pair = (_expand(row[f"{kind}_{c}"], np.uint64).astype(np.float64) for c in ("word", "pair"))
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[np.concatenate(([0], ends[:-1]))] = word[ends - 1]  # as many starts as ends
        found.append([word, context, pair])
    return sizes, uses, *found


def context_bucket(count: np.ndarray) -> np.ndarray:
    """The count itself up to four, then one bucket per power of two."""
    return np.where(count <= 4, count, 2 + np.ceil(np.log2(np.maximum(count, 4)))).astype(np.int64)


def held_out_histogram(tokens: DataFrame, n_kept: int) -> DataFrame:
    """(bucket, n2, n1, tokens, p2, p1): tokens of the documents that teach the weights, in cells.

    Their estimates come from counts without any of these documents (``n_kept`` tokens are
    left). Cells are context buckets by quarter octaves of the bigram's and half octaves of the
    word's relative frequency, with sums of both; their number is bounded by construction.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, uses, whole, held = _parts(row)
                use = np.repeat(uses == 2, sizes)
                word, context, pair = (x[use] - y[use] for x, y in zip(whole, held))
                p1, p2 = word / max(1, n_kept), np.where(context > 0, pair / np.maximum(context, 1), 0.0)
                with np.errstate(divide="ignore"):
                    n2, n1 = (np.where(p > 0, np.minimum(254, -np.log2(p) * f), 255).astype(np.int64) for p, f in ((p2, 4), (p1, 2)))
                cell, back = np.unique((context_bucket(context) << 16) | (n2 << 8) | n1, return_inverse=True)
                sums = [np.bincount(back, x, len(cell)) for x in (None, p2, p1)]
                yield _to_arrow([((c >> 16), (c >> 8) & 255, c & 255, int(k), float(a), float(b)) for c, k, a, b in zip(cell.tolist(), *sums)], "bucket int, n2 int, n1 int, tokens long, p2 double, p1 double")

    got = tokens.mapInArrow(releasing(run), "bucket int, n2 int, n1 int, tokens long, p2 double, p1 double")
    return got.groupBy("bucket", "n2", "n1").agg(F.sum("tokens").alias("tokens"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))


def mixture_weights(cells: pd.DataFrame, v: int, rounds: int) -> np.ndarray:
    """Weights (bigram, word, uniform) per context bucket by expectation-maximisation.

    Bucket 0 holds contexts never seen, whose bigram part is nothing. A bucket without
    held-out tokens takes the weights of the next lower one, the first ones the starting
    weights. No part falls below 1e-6, so an event that no held-out token showed keeps some
    probability.
    """
    weights = np.zeros((70, 3))
    for b in range(len(weights)):
        own = cells[cells["bucket"] == b]
        lam = np.array([0.0, 0.6, 0.4]) if b == 0 else np.array([0.4, 0.4, 0.2])
        if not len(own):
            weights[b] = weights[b - 1] if b > 1 else lam
            continue
        k = own["tokens"].to_numpy(float)
        p = np.stack([own["p2"] / k, own["p1"] / k, np.full(len(own), 1 / (v + 1))], axis=1)
        for _ in range(rounds):
            share = p * lam
            lam = (k[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / k.sum()
        lam = np.maximum(lam, [0.0, 1e-6, 1e-6] if b == 0 else 1e-6)
        weights[b] = lam / lam.sum()
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def language_model_scores(docs: DataFrame, train: Column, spec: LmSpec = LmSpec()) -> DataFrame:
    """Per row of (doc_id, text): log10 probability under the model, and under add-one unigrams.

    Words are lower-cased (A-Z) ``[^\\x20\\x09-\\x0D]+``; a text ends with one end token, so a
    null or empty text has that token alone. ``train`` says which rows are learnt from (null:
    learnt from); all rows are scored. ``docs`` must come in the same order when it is read
    again, as files do. Repeated rows count as often as they occur, a null
    doc_id stays null, and other columns are not read. Empty in, empty out.
    """
    tokens, n, n_held, v = count_tokens(docs, train, spec)
    weights = mixture_weights(held_out_histogram(tokens, n - n_held).toPandas().sort_values(["bucket", "n2", "n1"]), v, spec.rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, uses, (word, context, pair), _ = _parts(row)
                lam = weights[context_bucket(context)]
                p = lam[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0) + lam[:, 1] * word / max(1, n) + lam[:, 2] / (v + 1)
                first = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, first)
                base = add(np.log10((word + 1) / (n + v + 1)))
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                cols = [uses == 0, sizes, add((word > 0).astype(np.int64)), np.full(len(sizes), n), base, add(np.log10(p))]
                yield pa.RecordBatch.from_arrays([_ids_in(row["doc_ids"]), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[f.split()[0] for f in SCORES.split(", ")])

    return tokens.mapInArrow(releasing(run), SCORES)
