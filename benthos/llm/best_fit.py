"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A document longer than a sequence is cut so that all pieces but the first fill one. Pieces of
one length are alike to the rule, so Spark counts the lengths (as many as a sequence has
tokens at most) and the rule runs over the counts: it fills a bin greedily with the longest
pieces that fit, then takes out the smallest and puts in two waiting pieces whose sum is the
largest that fits the gap so expanded, if that is more than what was taken out. The same bin
is made as often as its pieces last. A bin is made until one of its lengths runs short of what
it uses (limit / length pieces at most), and then uses fewer of that length, so there are less
than sum(1 + limit / length) different bins, about 9,000 for 1,024 tokens, whatever the input.
Pieces then take the places of their length by rank. Ranks are counted per reading task, and
the tasks' counts are added up per length.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benthos.llm.packing import WordTokens
from benthos.llm.text import SpacedWords, releasing, utf8
from benthos.session import materialize


class SpacedTokens(WordTokens):
    """Ids of texts by a byte-level tokenizer whose tokens take the space before a word along.

    Its pre-tokens end where white space follows other characters, so a text's ids are those of
    its words with the space before them, and each distinct one is encoded once. Tokenizers with
    a normaliser, a prefix space or other pre-tokens encode whole texts.
    """

    units = staticmethod(lambda data, off: SpacedWords(data, off, lower=False))

    def whether_by_word(self) -> bool:
        has = json.loads(self.tokenizer.to_str())
        pre, added = has["pre_tokenizer"] or {}, has["added_tokens"]
        plain = not has["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\v\f\r") for t in added)


@functools.lru_cache(1)
def spaced_tokens(path: str) -> SpacedTokens:
    return SpacedTokens(path)


Bin = tuple[dict[int, int], int]


def best_two_fit(counts: dict[int, int], limit: int, stop: float = 0.0) -> list[Bin]:
    """({length: pieces of it in a bin}, bins alike) for so many pieces of each length.

    Bins begun when a share of ``stop`` or less of all pieces is left are filled greedily alone.
    """
    left = np.zeros(limit + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= limit:
            raise ValueError(f"a piece of {size} tokens in bins of {limit}")
        left[size] = n
    total = left.sum()
    # the largest length up to each that is still there
    below, bins = np.maximum.accumulate(np.where(left > 0, np.arange(limit + 1), 0)), []
    while size := int(below[limit]):
        one, gap = {}, limit
        while size:
            one[size] = min(int(left[size]), gap // size)
            gap -= one[size] * size
            size = int(below[min(gap, size - 1)])
        least = min(one)
        if left.sum() > stop * total and (pair := _tighter(left, one, least, gap)):
            one[least] -= 1
            for size in pair:
                one[size] = one.get(size, 0) + 1
            one = {s: n for s, n in one.items() if n}
        many = min(int(left[s]) // n for s, n in one.items())
        bins.append((one, many))
        for s, n in one.items():
            left[s] -= n * many
        below = np.maximum.accumulate(np.where(left > 0, np.arange(limit + 1), 0))
    return bins


def fewest_bins(counts: dict[int, int], limit: int) -> list[Bin]:
    """The fewest bins of best-two-fit with replacements throughout, or up to a share of the pieces.

    Two small pieces spent on a tighter bin are missing where only small gaps are left.
    """
    return min((best_two_fit(counts, limit, stop) for stop in STOPS), key=lambda bins: sum(many for _, many in bins))


#: Shares of the pieces left at which replacements end; the first that gives the fewest bins counts.
STOPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0)


def _tighter(left: np.ndarray, one: dict[int, int], least: int, gap: int) -> tuple[int, int] | None:
    """The two waiting lengths with the largest sum up to ``least`` + ``gap``, if over ``least``; ties: the largest length."""
    room = least + gap
    if not gap or room < 2:
        return None
    waiting = left[:room].copy()
    for s, n in one.items():
        if s < room:
            waiting[s] -= n
    sizes = np.arange(room)
    below = np.maximum.accumulate(np.where(waiting > 0, sizes, 0))
    first = np.flatnonzero(waiting > 0)
    second = below[room - first]
    alone = (second == first) & (waiting[first] < 2)
    second[alone] = below[first[alone] - 1]
    total = np.where(second > 0, first + second, 0)
    if not len(total) or total.max() <= least:
        return None
    i = len(total) - 1 - int(np.argmax(total[::-1]))
    return int(first[i]), int(second[i])


def places(bins: list[Bin]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, pieces in a bin, first bin, offset of the first piece) per length and kind of bin."""
    out, number, used = [], 0, {}
    for one, many in bins:
        at = 0
        for size in sorted(one, reverse=True):
            n, lo = one[size], used.get(size, 0)
            used[size] = lo + n * many
            out.append((size, lo, used[size], n, number, at))
            at += n * size
        number += many
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """A row per piece, with the task that read it and its number among that task's pieces of its length."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = spaced_tokens(tokenizer), TaskContext.get().partitionId()
        names, seen, tail = [f.split()[0] for f in PIECES.split(", ")], [0] * (limit + 1), np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            for doc, (ids, _) in zip(batch.column(0).to_pylist(), tokens.encode(*utf8(batch.column(1)))):
                ids = np.concatenate([ids, tail])
                raw = ids.astype("<u4").tobytes()
                start, stop = 0, len(ids) % limit or limit
                for piece in range(-(-len(ids) // limit)):
                    size = stop - start
                    rows.append((doc, piece, start, size, zlib.crc32(raw[4 * start : 4 * stop]), part, seen[size]))
                    seen[size] += 1
                    start, stop = stop, stop + limit
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "piece" else pa.int64()) for c, n in zip(cols, names)], names=names)
        tokens.shrink()

    return docs.mapInArrow(releasing(run), PIECES)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text without special tokens, then ``end_id``; a
    null or empty text has the end id alone. Only documents of more than ``limit`` ids are cut:
    all pieces but the first have ``limit`` ids. Sequences are numbered from 0 and hold pieces
    side by side from offset 0. Repeated rows are packed as often as they occur, a null doc_id
    stays null, other columns are not read. The pieces' table (no ids) is written once; the
    driver holds a count per length. Empty in, empty out.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer, end_id, limit), "best-fit-pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    plan = spark.createDataFrame(places(fewest_bins(counts, limit)), "length long, lo long, hi long, uses long, first long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    same = (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(plan), same).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        F.expr("first + (rank - lo) div uses").alias("sequence_id"),
        (F.col("at") + nth % F.col("uses") * ranked["length"]).alias("offset"),
    )
