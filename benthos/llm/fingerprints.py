"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of paragraphs.

A text is cut at line feeds into paragraphs; runs of paragraphs form sections, which end at
a blank line or where the paragraph's own hash says so (about one in eight), so an edit
moves no border far away. A paragraph is cut into pieces after each character where a hash
of the last four characters is larger than at any of the eight characters before and after,
so a piece has 17 characters on average in any script, with blanks or without, and an edit
moves cuts only within a dozen characters. Text that repeats itself has no such place; there,
pieces of 64 characters or a little more end where the hash is as large as any near it.
Every cut keeps its characters: the leaves' texts, in order, are the whole text. Hashes go up
from pieces to paragraphs, sections and the root, which is the fingerprint: equal roots mean
equal texts. Two trees are compared from the root down;
equal branches are skipped and what differs locates an edit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benthos.session import materialize

#: Characters that a hash covers, that a cut looks at on each side, and that are read at once.
LAST, REACH, BLOCK = 4, 8, 1 << 20
#: Pieces beyond LONG characters are cut again at LEAST or more.
LONG, LEAST = 128, 64
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _h(kind: bytes, *parts: bytes) -> bytes:
    return blake2b(b"".join(parts), digest_size=16, person=kind).digest()


class MerkleTree:
    """root; sections: [(hash, chars, [(hash, chars, [(hash, chars), ...]), ...]), ...]."""

    def __init__(self, text: str):
        self.sections, paragraphs, pieces = [], [], []
        data = text.encode("utf-32-le", "surrogatepass")
        at = begun = 0
        for end in _piece_ends(np.frombuffer(data, "<u4")):
            pieces.append((_h(b"piece", data[4 * at : 4 * end]), end - at))
            at = end
            if text[end - 1] == "\n" or end == len(text):
                paragraphs.append((_h(b"paragraph", *(h for h, _ in pieces)), end - begun, pieces))
                if text[begun:end].isspace() or paragraphs[-1][0][0] < 32:
                    self._section(paragraphs)
                    paragraphs = []
                begun, pieces = end, []
        if paragraphs:
            self._section(paragraphs)
        self.root = _h(b"root", *(h for h, _, _ in self.sections))

    def _section(self, paragraphs: list) -> None:
        self.sections.append((_h(b"section", *(h for h, _, _ in paragraphs)), sum(n for _, n, _ in paragraphs), paragraphs))

    @property
    def fingerprint(self) -> str:
        return self.root.hex()


def _piece_ends(codes: np.ndarray) -> list[int]:
    """Where pieces end, line feeds included; what lies in other paragraphs has no influence."""
    n, cuts, ties = len(codes), [np.flatnonzero(codes == 10) + 1], []
    for lo in range(0, n, BLOCK):
        begin, hi = max(0, lo - REACH - LAST), min(n, lo + BLOCK)
        part = codes[begin : hi + REACH]
        line = part == 10
        seat = np.arange(1, len(part) + 1) + REACH * (np.cumsum(line) - line + 1)  # a gap before each paragraph
        apart = np.zeros(int(seat[-1]) + REACH + 1, np.uint32)
        apart[seat] = part + np.uint32(1)
        h = apart * _FACTORS[0]
        for j in range(1, LAST):
            h[j:] += apart[:-j] * _FACTORS[j]
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(factor)
        h = (h ^ (h >> np.uint32(16))) | np.uint32(1)
        h[apart == 0] = 0
        near = np.zeros_like(h)
        for j in range(1, REACH + 1):
            np.maximum(near[j:], h[:-j], out=near[j:])
            np.maximum(near[:-j], h[j:], out=near[:-j])
        own, near = h[seat][lo - begin : hi - begin], near[seat][lo - begin : hi - begin]
        cuts.append(np.flatnonzero(own > near) + lo + 1)
        ties.append(np.flatnonzero(own == near) + lo + 1)
    ends = np.unique(np.concatenate([*cuts, [n]])) if n else np.zeros(0, np.int64)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > LONG)
    if not len(wide):
        return ends.tolist()
    tied, more = np.concatenate(ties), []
    for i in wide.tolist():
        at, stop = int(ends[i - 1]) if i else 0, int(ends[i])
        for x in tied[np.searchsorted(tied, at + LEAST) : np.searchsorted(tied, stop)].tolist():
            if x - at >= LEAST:
                more.append(x)
                at = x
    return np.union1d(ends, np.array(more, np.int64)).tolist()


def likeness(a: MerkleTree, b: MerkleTree) -> float:
    """Share of characters in equal branches: 2 * common / (chars of both); 1 for equal roots.

    Sections are matched first, then the paragraphs of what is left, then their pieces.
    """
    if a.root == b.root:
        return 1.0
    total, common, left, right = sum(s[1] for s in a.sections) + sum(s[1] for s in b.sections), 0, a.sections, b.sections
    for level in range(3):
        have = Counter(x[0] for x in right)
        rest = []
        for x in left:
            if have[x[0]]:
                have[x[0]] -= 1
                common += x[1]
            else:
                rest.append(x)
        spare = []
        for x in right:
            if have[x[0]]:
                have[x[0]] -= 1
                spare.append(x)
        if level < 2:
            left, right = [y for x in rest for y in x[2]], [y for x in spare for y in x[2]]
    return 2 * common / total if total else 1.0


def differences(a: MerkleTree, b: MerkleTree) -> list[tuple[int, int]]:
    """Character ranges of ``a`` whose pieces are in no branch that ``b`` has, merged."""
    have = [Counter(s[0] for s in b.sections), Counter(p[0] for s in b.sections for p in s[2]), Counter(x[0] for s in b.sections for p in s[2] for x in p[2])]
    at, out = 0, []
    for s in a.sections:
        if have[0][s[0]]:
            at += s[1]
            continue
        for p in s[2]:
            if have[1][p[0]]:
                at += p[1]
                continue
            for h, n in p[2]:
                if not have[2][h]:
                    if out and out[-1][1] == at:
                        out[-1] = (out[-1][0], at + n)
                    else:
                        out.append((at, at + n))
                at += n
    return out


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


#: Bytes of text that one task takes.
PART_BYTES = 16 << 20

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_stop long"
_EDGES = SCHEMA + ", part int, edge int, text string"


def _compared(doc: int | None, text: str, tree: MerkleTree, following: str, following_tree: MerkleTree) -> tuple:
    """The row of a document that is followed by another."""
    new = edited(text, following)
    new_tree = MerkleTree(new)
    gone = differences(new_tree, tree)
    return (
        doc, len(text), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), tree.fingerprint, new_tree.fingerprint,
        likeness(tree, new_tree), likeness(tree, following_tree), gone[0][0] if gone else None, gone[-1][1] if gone else None,
    )


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _within_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents but each part's last; the part's first and last document as edges 1 and 2."""
    part, before, ready = TaskContext.get().partitionId(), None, []
    nothing = (None,) * 8
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree = MerkleTree(text)
            ready.append((*_compared(*before, text, tree), None, None, None) if before else (doc, *nothing, part, 1, text))
            before = doc, text, tree
            if len(ready) >= 5000:
                yield _batch(ready, _EDGES)
                ready = []
    if before:
        ready.append((before[0], *nothing, part, 2, before[1]))
    yield _batch(ready, _EDGES)


def _across_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, following in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield _batch([_compared(doc, text, MerkleTree(text), following, MerkleTree(following))], SCHEMA)


#: Parts that are numbered in one task.
PARTS_AT_ONCE = 4096


def _next_parts(parts: DataFrame) -> DataFrame:
    """(part, next) of parts that are not empty, the first following the last; numbered in blocks, so no task sees all."""
    blocks = parts.withColumn("block", F.floor(F.col("part") / PARTS_AT_ONCE))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", before.alias("start"))  # a row per PARTS_AT_ONCE parts
    inner = F.row_number().over(Window.partitionBy("block").orderBy("part"))
    seated = blocks.join(starts, "block").select("part", (F.col("start") + inner - 1).alias("seat"))
    total = seated.agg(F.max("seat").alias("last"))
    wrapped = seated.crossJoin(F.broadcast(total))  # one row
    after = seated.select(F.col("seat").alias("to"), F.col("part").alias("next"))
    return wrapped.select("part", F.when(F.col("seat") < F.col("last"), F.col("seat") + 1).otherwise(0).alias("to")).join(after, "to").select("part", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of (doc_id, text), of its edited text, and both likenesses.

    The next document is the one that follows in ascending doc_id; after the last comes the
    first, and a lone document follows itself. Null text counts as empty. Rows that share a
    doc_id follow one another in order of their texts' hashes; rows with null doc_id come before
    all others, in the same order. edit_start and edit_stop bound what the trees show as changed
    in the edited text (null if nothing). Two empty texts have likeness 1. Other columns are not
    read. Empty in, empty out.

    Rows are dealt by ranges of that order, about PART_BYTES of text a part, so a doc_id that
    repeats without end is spread as well. Each part compares its rows; only the last row of a
    part and the first of the next meet in a second, small step.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("seat").asc()]
    placed = docs.withColumns({"tie": F.xxhash64("text"), "seat": F.monotonically_increasing_id()})  # the seat tells equal rows apart
    dealt = placed.repartitionByRange(max(1, -(-size // PART_BYTES)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = materialize(dealt.mapInArrow(_within_parts, _EDGES), "fingerprints")

    edges = made.where("edge is not null").select("part", "edge", "doc_id", "text")
    following = _next_parts(edges.where("edge = 1").select("part"))
    first = edges.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = edges.where("edge = 2").select("part", "doc_id", "text").join(following, "part").join(first, "next")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return made.where("edge is null").select(*names).unionByName(last.select("doc_id", "text", "following").mapInArrow(_across_parts, SCHEMA))
