"""Runs of repeated words: maximal stretches whose words recur at a fixed distance.

A suffix automaton is built over the words. Its suffix links form a tree, in which the path
from a prefix's state to the root holds that prefix's suffixes. The words are then appended
one by one: a link-cut access to the state of prefix i makes its path to the root one
preferred path, coloured i. The pieces it is joined from still bear the end at which their
words were seen last. A piece with colour j says: the longest suffix that it holds, ``deep``
words, ended at j before, and no longer one ended there. With d = i - j, ``deep`` >= d makes
the last 2 d words a square and the last ``deep`` + d words have smallest period d; while the
run goes on, each further word shows the same start and period again, so the last end seen is
the run's end. An access touches O(log n) pieces, amortised.

Before that, a filter by the shortest run asked for: of a run of at least ``least`` words with
two periods or more, all words lie in windows of ceil(least / 2) words that occur twice in the
text. Only stretches covered by such windows are read by the automaton; runs cannot reach
beyond them. The filter goes by hashes of windows, the automaton by the words' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.llm.text import Words, chunks, combine, utf8

Run = tuple[int, int, int]


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, longest, prefix): of each state its suffix link and longest length, and the state of each prefix.

    State 1 is the start; link 0 is none.
    """
    step: list[dict[int, int]] = [{}, {}]
    link, longest, prefix, last = [0, 0], [0, 0], [], 1
    for c in words:
        new, p = len(step), last
        step.append({})
        link.append(1)
        longest.append(longest[last] + 1)
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if longest[q] != longest[p] + 1:
                twin = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                longest.append(longest[p] + 1)
                link[q] = twin
                while p and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        prefix.append(new)
        last = new
    return link, longest, prefix


def find_runs(words: list[int], least: int = 12) -> list[Run]:
    """(start, length, period) of every run with at least ``least`` words and two periods, by start, then period."""
    link, longest, prefix = suffix_automaton(words)
    size = len(link)
    # preferred paths are splay trees in order of depth; ``up`` is the parent there, or above the path's top
    up, shallow, deep = link, [0] * size, [0] * size
    shallow[0] = deep[0] = -1
    colour, ends = [0] * size, {}
    for i, state in enumerate(prefix, 1):
        lower, x = 0, state
        while x:
            y = up[x]
            if shallow[y] == x or deep[y] == x:  # splay x to the top of its path
                while True:
                    z = up[y]
                    left = shallow[y] == x
                    if shallow[z] == y or deep[z] == y:
                        above = up[z]
                        outer = shallow[z] == y
                        if left == outer:  # y over z, then x over y
                            if left:
                                b = shallow[z] = deep[y]
                                if b:
                                    up[b] = z
                                deep[y] = z
                                b = shallow[y] = deep[x]
                                if b:
                                    up[b] = y
                                deep[x] = y
                            else:
                                b = deep[z] = shallow[y]
                                if b:
                                    up[b] = z
                                shallow[y] = z
                                b = deep[y] = shallow[x]
                                if b:
                                    up[b] = y
                                shallow[x] = y
                            up[z], up[y] = y, x
                        else:  # x between the two
                            lo, hi = (z, y) if left else (y, z)
                            b, e = shallow[x], deep[x]
                            deep[lo], shallow[hi] = b, e
                            if b:
                                up[b] = lo
                            if e:
                                up[e] = hi
                            shallow[x], deep[x] = lo, hi
                            up[lo] = up[hi] = x
                        up[x], top = above, z
                    else:
                        if left:
                            b = shallow[y] = deep[x]
                            deep[x] = y
                        else:
                            b = deep[y] = shallow[x]
                            shallow[x] = y
                        if b:
                            up[b] = y
                        up[y], up[x], above, top = x, z, z, y
                    if shallow[above] == z:
                        shallow[above] = x
                    elif deep[above] == z:
                        deep[above] = x
                    else:
                        colour[x] = colour[top]
                        break
                    y = above
            j = colour[x]
            if j:
                if deep[x]:  # what lies deeper leaves the path and keeps its colour
                    colour[deep[x]] = j
                common, d = longest[x], i - j
                if common >= d:
                    ends[i - common - d, d] = i
            deep[x] = lower
            lower, x = x, up[x]
        colour[lower] = i
    return sorted((start, end - start, d) for (start, d), end in ends.items() if end - start >= least)


def repeated_stretches(numbers: np.ndarray, row: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of one row's words covered by windows of so many words that occur twice in the row."""
    m = len(numbers) - window + 1
    if m < 2:
        return []
    acc = row[:m].astype(np.uint64)
    for j in range(window):
        acc = combine(acc, numbers[j : j + m].astype(np.uint64))
    at = np.flatnonzero(row[:m] == row[window - 1 :])
    _, back, count = np.unique(acc[at], return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    edge = np.zeros(len(numbers) + 1, np.int64)
    edge[twice] += 1
    edge[twice + window] -= 1
    covered = np.zeros(len(numbers) + 2, bool)
    covered[1:-1] = np.cumsum(edge[:-1]) > 0
    turn = covered[1:] != covered[:-1]
    inside = covered[1:-2] & covered[2:-1] & (row[1:] != row[:-1])  # two rows' stretches side by side
    starts = np.flatnonzero(turn & covered[1:])
    stops = np.flatnonzero(turn & ~covered[1:])
    cut = np.flatnonzero(inside) + 1
    starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
    return list(zip(starts.tolist(), stops.tolist()))


def _collapsed(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row's kept words joined by one space, and the rows' offsets."""
    word = np.flatnonzero(kept)
    row, size = w.row[word], (w.end - w.start)[word]
    final = np.ones(len(word), bool)
    final[:-1] = row[1:] != row[:-1]
    edge = np.zeros(len(w.bytes) + 1, np.int8)
    edge[w.start[word]] += 1
    edge[w.end[word]] -= 1
    inside = np.cumsum(edge, dtype=np.int8).astype(bool)
    inside[w.end[word[~final]]] = True  # each kept word but the row's last takes the space after it along
    text = np.append(w.bytes, np.uint8(32))
    text[w.end[word[~final]]] = 32
    length = np.bincount(row, weights=size + ~final, minlength=w.rows).astype(np.int64)
    return text[inside], np.concatenate(([0], np.cumsum(length)))


class Found:
    """Runs of some rows: of each row where its runs start in the lists, and what is left without their repetitions."""

    def __init__(self, data: np.ndarray, off: np.ndarray, least: int):
        w = Words(data, off, lower=False)
        numbers = w.distinct()[1]
        first, runs = w.bounds(), []
        edge = np.zeros(len(numbers) + 1, np.int64)
        for a, z in repeated_stretches(numbers, w.row, (least + 1) // 2):
            if z - a >= least:
                row = w.row[a]
                for start, length, period in find_runs(numbers[a:z].tolist(), least):
                    runs.append((row, a + start - first[row], length, period))
                    edge[a + start + period] += 1
                    edge[a + start + length] -= 1
        self.words = np.diff(first)
        row, self.start, self.length, self.period = np.array(runs, np.int64).reshape(-1, 4).T
        self.runs = np.searchsorted(row, np.arange(w.rows + 1))
        self.text, self.text_off = _collapsed(w, np.cumsum(edge[:-1]) == 0)


RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row's whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared as they are. ``runs`` holds
    (start, length, period) of every maximal run of at least ``least`` words and two periods, by
    start, then period. ``collapsed`` joins by one space the words that no run contains after
    its first period. A null or empty text has no words, no runs and an empty ``collapsed``.
    Rows are read one by one: repeated rows come as often as they occur, a null doc_id stays
    null, other columns are not read, nothing is shuffled. A task holds about a megabyte of text
    or one row, whichever is more. Empty in, empty out.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in chunks(off):
                f = Found(data, off[lo : hi + 1], least)
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (f.start, f.length, f.period)], fields=list(RUN))
                texts = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(f.text_off), pa.py_buffer(f.text)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(f.words), pa.ListArray.from_arrays(pa.array(f.runs.astype(np.int32)), runs), texts], names=names)

    return docs.mapInArrow(run, SCHEMA)


def repeat_passages(text: Column, key: Column) -> Column:
    """The text with passages repeated in one row of ten: by h = crc32 of the key in decimal, and g = floor(h / 10).

    If h % 10 = 0 and the text has n > 0 words, each word i >= a becomes word a + (i - a) % p,
    where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); the words are joined by spaces.
    Other texts, and those without a key, stay as they are.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.element_at(words, (i + 1).cast("int"))), " ")

    edited = F.element_at(F.transform(F.array(words), lambda x: F.when(F.size(x) > 0, repeated(x))), 1)  # the words are split once
    return F.when(h % 10 == 0, F.coalesce(edited, text)).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """Per row the number of runs, the longest (ties: least start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    cols = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.back"), F.col("best.length"), -F.col("best.less")
    return cols.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
