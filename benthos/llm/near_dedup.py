"""Near-duplicate components by HyperMinHash sketches, banding and exact verification.

A document's set is the distinct hashed k-word shingles of its whole text. One pass writes
a sketch per document: 2^p buckets, each holding the leading-zero count and the leading
mantissa bits of the smallest hash that fell in it (HyperMinHash); empty buckets borrow
from a bucket picked by a fixed hash sequence, which keeps P(equal register) = Jaccard.
Documents with one and the same set collapse to a representative first, so groups of exact
copies cost one row. Bands of registers then make buckets of representatives:

1. each bucket links its members to its smallest one (a star, never all pairs);
2. buckets whose members still lie in several components get a second star, around another
   member, and
3. documents of buckets that remain open meet across components where they share a rare
   shingle early enough to reach the threshold at all (prefix and position bounds, exact).

Candidates must pass the collision-corrected Jaccard estimate (with six standard errors of
slack) and are then confirmed on full sets of real shingles, words compared byte by byte. The bands' size is chosen so that a pair at the
threshold is missed with probability below ``miss``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.llm.text import chunks, mix, releasing, shared_shingles, shingle_sets, utf8
from benthos.operators.graph import connected_components
from benthos.session import materialize

EMPTY = np.uint16(65535)
#: A list of this many ids at most (8 bytes each) is sent to all executors; a longer one is joined by shuffle.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class NearDedup:
    """shingle: words; threshold: percent; buckets: 2^p registers; mantissa: bits kept of each; miss: chance to lose a pair at the threshold."""

    shingle: int = 5
    threshold: int = 80
    p: int = 9
    mantissa: int = 10
    miss: float = 1e-8

    @functools.cached_property
    def banding(self) -> tuple[int, int]:
        """(bands, registers in a band): the longest bands that keep the miss bound."""
        k = 1 << self.p
        for r in range(16, 0, -1):
            if (1 - (self.threshold / 100) ** r) ** (k // r) <= self.miss:
                return k // r, r
        raise ValueError("no banding keeps the bound; raise p")


@functools.lru_cache
def _donors(p: int, tries: int = 64) -> np.ndarray:
    k = 1 << p
    at = np.arange(k, dtype=np.uint64)
    return np.stack([(mix(at * np.uint64(1000003) + np.uint64(t + 1)) % np.uint64(k)).astype(np.int64) for t in range(tries)])


def registers(s: np.ndarray, spec: NearDedup) -> tuple[np.ndarray, int]:
    """HyperMinHash registers of a set, empty ones filled from donors; how many held a value."""
    k, bits = 1 << spec.p, 64 - spec.p
    out = np.full(k, EMPTY, np.uint16)
    g = np.sort(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    bucket = g >> np.uint64(bits)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(g) else np.zeros(0, np.int64)
    fraction, exponent = np.frexp((g[first] & np.uint64((1 << bits) - 1)).astype(np.float64))
    scale = 1 << spec.mantissa
    out[bucket[first].astype(np.int64)] = (bits - exponent) * scale + np.maximum(0, (2 * fraction - 1) * scale).astype(np.int64)
    held = len(first)
    if 0 < held < k:
        hole = np.flatnonzero(out == EMPTY)
        solid = out.copy()
        for row in _donors(spec.p):
            out[hole] = solid[row[hole]]
            hole = hole[out[hole] == EMPTY]
            if not len(hole):
                break
        if len(hole):
            full = np.flatnonzero(solid != EMPTY)
            out[hole] = solid[full[np.searchsorted(full, hole) % len(full)]]
    return out, held


def corrected_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, spec: NearDedup) -> np.ndarray:
    """Share of equal registers, less what different elements share by chance.

    Two unrelated minima agree when their leading-zero counts agree and then their mantissa
    bits do: c = sum over z of P_a(z) P_b(z) / 2^mantissa, and J = (match - c) / (1 - c).
    """
    k = 1 << spec.p
    z = np.arange(64 - spec.p + 1, dtype=np.float64)

    def leading(n: np.ndarray) -> np.ndarray:
        load = np.maximum(n / k, 1.0)[:, None]
        return np.exp(-load * 2.0 ** (-z - 1)) - np.exp(-load * 2.0**-z)

    c = (leading(na) * leading(nb)).sum(axis=1) / (1 << spec.mantissa)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def sketches(docs: DataFrame, spec: NearDedup) -> DataFrame:
    """(doc_id, n_shingles, set_id, held, regs) per row; set_id: 16 bytes that name the set."""
    from hashlib import blake2b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            n, ids, held, regs = [], [], [], []
            for s in shingle_sets(data, off, spec.shingle):
                r, h = registers(s, spec)
                n.append(len(s))
                ids.append(blake2b(s.tobytes(), digest_size=16).digest())
                held.append(h)
                regs.append(r.tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(held, pa.int32()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "held", "regs"])

    return docs.mapInArrow(releasing(run), "doc_id long, n_shingles long, set_id binary, held int, regs binary")


def _estimate(pairs: DataFrame, reps: DataFrame, spec: NearDedup) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule the threshold out."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("held").alias(f"h{x}"), F.col("regs").alias(f"r{x}"))
    t = spec.threshold / 100
    # sets of too different sizes cannot reach the threshold
    sized = pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("ma")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("mb")), "b")
    sized = sized.where(f"least(ma, mb) * 100 >= {spec.threshold} * greatest(ma, mb)").select("a", "b")
    both = sized.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ha", "hb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                na, nb, ha, hb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(2, 6))
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (6, 7))
                slack = 6 * np.sqrt(t * (1 - t) / np.maximum(1, np.minimum(ha, hb)))
                keep = corrected_jaccard(ra, rb, na, nb, spec) >= t - slack
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(releasing(run), "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, spec: NearDedup) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            order = pa.array(np.arange(2 * n).reshape(2, n).T.reshape(-1))  # a0, b0, a1, b1, ...
            data, off = utf8(pa.concat_arrays([batch.column(2).cast(pa.large_string()), batch.column(3).cast(pa.large_string())]).take(order))
            for lo, hi in chunks(off[::2]):
                sizes, shared = shared_shingles(data, off[2 * lo : 2 * hi + 1], spec.shingle)
                union = sizes[::2] + sizes[1::2] - shared
                keep = (union > 0) & (100 * shared >= spec.threshold * union)
                yield batch.slice(lo, hi - lo).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(releasing(run), "a long, b long")


def _rare_shingle_pairs(docs: DataFrame, texts: DataFrame, spec: NearDedup) -> DataFrame:
    """(a, b), a < b, of ``docs`` (doc_id, label) with different labels that may reach the threshold.

    Shingles are put in the order of their frequency among these documents, rarest first.
    With t the threshold, the larger set of a qualifying pair has a common shingle among its
    first n - ceil(t n) + 1, the smaller one among its first n - ceil(2t/(1+t) n) + 1, and the
    shingles from the first common one on must suffice for the overlap t/(1+t) (n_a + n_b).
    """
    t = spec.threshold / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, s in enumerate(shingle_sets(*utf8(batch.column(2)), spec.shingle)):
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ids[i])), pa.array(np.full(n, labels[i])), pa.array(np.full(n, n, np.int32)), pa.array(s.view(np.int64))], names=["doc_id", "label", "n", "h"])

    rows = docs.join(texts, "doc_id").select("doc_id", "label", "text").mapInArrow(releasing(run), "doc_id long, label long, n int, h long")
    rows = materialize(rows, "near-shingles")
    counted = rows.join(rows.groupBy("h").agg(F.count("*").alias("df")), "h")
    sorted_ = counted.groupBy("doc_id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    length = (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int")
    prefix = sorted_.select("doc_id", "label", "n", F.posexplode(F.slice("s", F.lit(1), length)).alias("at", "x")).select("doc_id", "label", "n", "at", "x.h")
    prefix = materialize(prefix, "near-prefixes")
    # sizes of partners differ by the threshold at most: they lie in one band of sizes or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(t)).cast("int") if t < 1 else F.col("n")
    big = prefix.select("h", band.alias("band"), F.col("doc_id").alias("p"), F.col("label").alias("lp"), F.col("n").alias("np"), F.col("at").alias("ap"))
    small = prefix.where(F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-9) + 1).select("h", F.explode(F.array(band, band + 1)).alias("band"), F.col("doc_id").alias("q"), F.col("label").alias("lq"), F.col("n").alias("nq"), F.col("at").alias("aq"))
    need = (F.col("np") + F.col("nq")) * (t / (1 + t)) - 1e-9
    fits = (F.col("np") >= F.col("nq")) & (F.col("p") != F.col("q")) & (F.col("lp") != F.col("lq")) & (F.col("nq") >= F.col("np") * t - 1e-9) & (F.least(F.col("np") - F.col("ap"), F.col("nq") - F.col("aq")) >= need)
    return big.join(small, ["h", "band"]).where(fits).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def near_duplicates(docs: DataFrame, spec: NearDedup = NearDedup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links; kept marks that document.
    Null and empty texts have an empty set: n_shingles 0, linked with nothing, kept. Rows
    that share a doc_id are one node. A row with null doc_id is returned unlinked with null
    component_id, and kept. Other columns of the input are not read. Empty in, empty out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = materialize(sketches(docs, spec), "near-sketches")
    named = sk.where("doc_id is not null and n_shingles > 0")
    total = named.count()
    classes = materialize(named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")), "near-classes")
    seen = _hot_join(named.select("doc_id", "set_id"), classes.where("k > 1"), "set_id", total)
    copies = materialize(seen.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "k"), "near-copies")
    firsts = classes.select(F.col("rep").alias("doc_id"), "set_id")
    reps = materialize(named.join(firsts, ["doc_id", "set_id"]).groupBy("doc_id", "set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("held").alias("held"), F.first("regs").alias("regs")), "near-reps")

    bands, width = spec.banding
    rows = reps.select("doc_id", "regs", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select("doc_id", F.xxhash64("band", F.substring("regs", F.col("band") * (2 * width) + 1, F.lit(2 * width))).alias("bucket"))
    shared = materialize(rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("k")).where("hub != last").select("bucket", "hub", "k"), "near-shared")
    members = materialize(_hot_join(rows, shared, "bucket", bands * total), "near-buckets")

    texts = _texts_of(docs, members.select("doc_id").distinct())
    tested = materialize(members.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-pairs")
    links = materialize(_verify(_estimate(tested, reps, spec), texts, spec), "near-links")
    for last in (False, True):
        label = connected_components(links, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
        marked = materialize(members.select("bucket", "doc_id", "k").join(label, "doc_id", "left").select("bucket", "doc_id", "k", F.coalesce("label", "doc_id").alias("label")), "near-marked")
        still = marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("k").alias("k"), F.min(F.struct(F.xxhash64("doc_id").alias("k"), F.col("doc_id").alias("hub"), "label")).alias("other")).where("x != y")
        if last:
            pairs = _rare_shingle_pairs(marked.join(still.select("bucket"), "bucket", "left_semi").select("doc_id", "label").distinct(), texts, spec)
        else:
            hub = still.select("bucket", "k", "other.hub", F.col("other.label").alias("hub_label"))
            pairs = _hot_join(marked.drop("k"), hub, "bucket", bands * total).where("label != hub_label").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
        pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = tested.unionByName(pairs)
        links = links.unionByName(materialize(_verify(_estimate(pairs, reps, spec), texts, spec), "near-links"))

    label = materialize(connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("label")), "near-labels")
    # components of representatives, then of their copies; the smallest doc_id of a set is its representative
    sized = label.join(classes.select("rep", "k"), "rep")
    joined = _hot_join(copies.select(F.col("a").alias("doc_id"), F.col("b").alias("rep")), sized, "rep", total)
    own = copies.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))  # a set that is linked with no other
    whole = joined.select("doc_id", F.col("label").alias("component")).unionByName(own).unionByName(label.select(F.col("rep").alias("doc_id"), F.col("label").alias("component")))
    whole = whole.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sk.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _hot_join(rows: DataFrame, table: DataFrame, key: str, total: int, share: float = 0.001) -> DataFrame:
    """Inner join with a table of one row per key and ``k``, how many rows have it; ``total`` rows at most.

    Keys of more than ``share`` of all rows are fewer than 1 / share: their part of the table is
    sent along, so that a hot key's rows stay where they are. All others are joined by shuffle.
    """
    hot = F.col("k") > max(1000, int(share * total))
    few = F.broadcast(materialize(table.where(hot), "near-hot"))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(table.where(~hot), key))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents that share a bucket; the id list is sent along only if it is short."""
    ids = materialize(ids, "near-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return materialize(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near-texts")
