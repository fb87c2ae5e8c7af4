"""Packing of tokenised documents into sequences by vector bin packing.

An example asks for a vector: tokens, one segment, loss-bearing tokens. The open sequence
has a vector of what is left under its three limits. Of a window of waiting examples the one
with the largest dot product of the two (each divided by the limits) is placed next. What
does not fit is cut off and waits on: an example is cut where the tokens or the loss-bearing
tokens run out, so a prompt may still fill a sequence that can bear no more loss. A sequence
is closed when nothing that waits fits. What a task has left at the end is cut into sequences
of powers of two, largest first, which need no padding. Tasks pack what they read: nothing is
shuffled, and a task holds one Arrow batch, its cache of words and the window.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.llm.text import Words, chunks, releasing, utf8


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 1024
    loss_tokens: int = 4096
    window: int = 128


def splits_at_space(tokenizer) -> bool:
    """Whether the tokenizer drops ASCII white space before it forms tokens, so that words can go one by one.

    Tried on its normaliser and pre-tokenizer: each white space character, single and double,
    between letters, digits and punctuation must lie in no pre-token.
    """
    if tokenizer.pre_tokenizer is None:
        return False
    for space in (c * n for c in " \t\n\x0b\x0c\r" for n in (1, 2)):
        for left in "a1.'é":
            for right in "b2,'s中":
                text = left + space + right
                plain = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
                if any(any(plain[i].isspace() for i in range(*span)) for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(plain)):
                    return False
    return True


class WordTokens:
    """Ids of texts, and where in the text each id's token starts (in code points).

    Where the tokenizer drops white space before it splits, the ids of a text are those of its
    white-space-separated words in order, and each distinct word is encoded once; words are
    told apart by their bytes. When the cache holds ``most`` words, and at a task's end, only
    those that came in more than one chunk of texts stay. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, with_starts: bool = False, most: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.with_starts, self.most = Tokenizer.from_file(path), with_starts, most
        self.by_word = self.whether_by_word()
        self._clear()

    units = staticmethod(lambda data, off: Words(data, off, lower=False))

    def whether_by_word(self) -> bool:
        return splits_at_space(self.tokenizer)

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.starts, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.int32), 0
        self.chunks = np.zeros(1 << 16, np.int32)  # in how many each word came

    def shrink(self) -> None:
        """Keep the words that came in several chunks; if they alone are half of ``most``, none."""
        words = list(self.number)  # in the order of their numbers
        keep = np.flatnonzero(self.chunks[: len(words)] > 1)
        at, size, ids, starts = self.at[keep], self.size[keep], self.ids, self.starts
        self._clear()
        if len(keep) > self.most // 2:
            return
        self.used = int(size.sum())
        first = np.cumsum(size) - size
        take = np.repeat(at - first, size) + np.arange(self.used)
        room = lambda x, n: np.concatenate([x, np.zeros(max(0, n - len(x)), x.dtype)])
        self.ids, self.starts = room(ids[take], 1 << 20), room(starts[take], 1 << 20)
        self.at, self.size, self.chunks = room(first, 1 << 16), room(size, 1 << 16), room(np.ones(len(keep), np.int32), 1 << 16)
        self.number = {words[i]: n for n, i in enumerate(keep.tolist())}

    def _learn(self, words: list[bytes]) -> None:
        encode = self.tokenizer.encode_batch if self.with_starts else self.tokenizer.encode_batch_fast  # the latter leaves offsets out
        got = encode([w.decode() for w in words], add_special_tokens=False)
        made = [e.ids for e in got]
        size = np.fromiter(map(len, made), np.int64, len(made))
        more, first = int(size.sum()), len(self.number)
        while self.used + more > len(self.ids):
            self.ids, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.starts))
        while first + len(words) > len(self.at):
            self.at, self.size, self.chunks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.chunks))
        self.ids[self.used : self.used + more] = np.fromiter(chain.from_iterable(made), np.uint32, more)
        if self.with_starts:
            self.starts[self.used : self.used + more] = np.fromiter((a for e in got for a, _ in e.offsets), np.int32, more)
        self.at[first : first + len(words)] = self.used + np.cumsum(size) - size
        self.size[first : first + len(words)] = size
        self.used += more
        self.number.update(zip(words, range(first, first + len(words))))

    def encode(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(ids, token starts if asked for) of each row."""
        if not self.by_word:
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                e = self.tokenizer.encode(data[a:z].tobytes().decode(), add_special_tokens=False)
                yield np.array(e.ids, np.uint32), np.array([x for x, _ in e.offsets], np.int64) if self.with_starts else None
            return
        for lo, hi in chunks(off):
            w = self.units(data, off[lo : hi + 1])
            first, back = w.distinct()
            if len(self.number) > self.most:
                self.shrink()
            raw = w.bytes.tobytes()
            words = [raw[a:z] for a, z in zip(w.start[first].tolist(), w.end[first].tolist())]
            number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
            if len(new := np.flatnonzero(number < 0)):
                number[new] = len(self.number) + np.arange(len(new))
                self._learn([words[i] for i in new.tolist()])
            self.chunks[number] += 1
            number = number[back]
            at, size = self.at[number], self.size[number]
            total = np.concatenate(([0], np.cumsum(size)))
            take = np.repeat(at - total[:-1], size) + np.arange(total[-1])
            flat, where = self.ids[take], None
            cut = total[w.bounds()].tolist()
            if self.with_starts:
                chars = np.concatenate(([0], np.cumsum((w.bytes & 0xC0) != 0x80)))
                begin = chars[w.start] - chars[w.off[w.row]]
                where = np.repeat(begin, size) + self.starts[take]
            for a, z in zip(cut[:-1], cut[1:]):
                yield flat[a:z], where[a:z] if self.with_starts else None


@functools.lru_cache(1)
def word_tokens(path: str, with_starts: bool) -> WordTokens:
    return WordTokens(path, with_starts)


def _loss_before(starts: np.ndarray, spans: list[tuple[int, int]] | None, chars: int) -> np.ndarray:
    """Loss-bearing tokens before each token, the end id after the text included, and in all."""
    at = np.concatenate([starts, [chars - 1]])
    mask = np.zeros(len(at), bool)
    for a, z in spans or ():
        mask |= (at >= a) & (at < z)
    return np.concatenate(([0], np.cumsum(mask)))


class _Packer:
    """Fills one sequence at a time from a window of waiting examples."""

    def __init__(self, limits: Limits, base: int):
        self.limits, self.next_id = limits, base
        self.per = [1 / x**2 for x in (limits.tokens, limits.segments, limits.loss_tokens)]
        self.prompts = False  # whether any token so far bears no loss
        self.waiting: list[list] = []  # [doc_id, ids, start, loss before each token]
        self.rest = np.zeros((2, 2 * limits.window + 2), np.int64)  # of each: tokens, loss-bearing tokens
        self.out: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.left = [self.limits.tokens, self.limits.segments, self.limits.loss_tokens]
        self.offset, self.placed = 0, []

    def _demands(self, room: int) -> tuple[np.ndarray, np.ndarray]:
        """What each waiting example could place now: tokens, and loss-bearing tokens among them."""
        n, loss = self.rest[0, : len(self.waiting)], self.rest[1, : len(self.waiting)]
        if not self.prompts:  # every token bears loss
            fits = np.minimum(n, min(room, self.left[2]))
            return fits, fits
        fits = np.minimum(n, room)
        bears = np.minimum(loss, fits)
        for i in np.flatnonzero((fits < n) | (loss > self.left[2])).tolist():
            _, _, start, before = self.waiting[i]
            stop = min(start + int(fits[i]), int(np.searchsorted(before, before[start] + self.left[2], "right")) - 1)
            fits[i], bears[i] = stop - start, before[stop] - before[start]
        return fits, bears

    def _step(self, tokens: int) -> bool:
        """Place the example whose demand has the largest dot product with what is left; whether one fitted."""
        fits, bears = self._demands(min(tokens, self.left[0]))
        gain = fits * (self.per[0] * self.left[0]) + bears * (self.per[2] * self.left[2]) + self.per[1] * self.left[1]
        i = int(np.argmax(np.where(fits > 0, gain, -1.0) if self.prompts else gain))
        n, loss = int(fits[i]), int(bears[i])
        if n <= 0:
            return False
        doc, ids, start, before = self.waiting[i]
        self.placed.append((doc, ids[: start + n], start, before))
        self.offset += n
        self.left = [self.left[0] - n, self.left[1] - 1, self.left[2] - loss]
        if start + n == len(ids):
            last = len(self.waiting) - 1
            self.waiting[i] = self.waiting[last]
            self.rest[:, i] = self.rest[:, last]
            self.waiting.pop()
        else:
            self.rest[0, i] -= n
            self.rest[1, i] -= loss
            self.waiting[i][2] = start + n
        if min(self.left[0], self.left[1]) <= 0 or self.left[2] <= 0 and not (self.prompts and self.waiting):
            self._close()
        return True

    def _close(self) -> None:
        at = 0
        for doc, ids, start, before in self.placed:
            n = len(ids) - start
            self.out.append((doc, start, n, zlib.crc32(ids[start:].astype("<u4").tobytes()), len(before) - 1, self.next_id, at, int(before[start + n] - before[start])))
            at += n
        self.next_id += 1
        self._open()

    def add(self, doc: int | None, ids: np.ndarray, before: np.ndarray, start: int = 0) -> None:
        n, loss = len(ids) - start, int(before[len(ids)] - before[start])
        self.prompts = self.prompts or loss < n
        if len(self.waiting) == self.rest.shape[1]:
            self.rest = np.concatenate([self.rest, np.zeros_like(self.rest)], axis=1)
        self.rest[:, len(self.waiting)] = n, loss
        self.waiting.append([doc, ids, start, before])

    def drain(self) -> None:
        """Place examples until the window has room again."""
        while len(self.waiting) > self.limits.window:
            if not self._step(self.limits.tokens):
                self._close()

    def finish(self) -> None:
        """Deal out what is left, the open sequence's pieces with it."""
        placed = self.placed
        self._open()
        for doc, ids, start, before in placed:
            self.add(doc, ids, before, start)
        while self.waiting:
            rest = int(self.rest[0, : len(self.waiting)].sum())
            goal = self.limits.tokens if rest >= self.limits.tokens else 1 << (rest.bit_length() - 1)
            now = self.next_id
            while self.next_id == now and self.offset < goal and self.waiting:
                if not self._step(goal - self.offset):
                    break
            if self.next_id == now and self.placed:
                self._close()


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits = Limits(), loss: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document's ids are those of its whole text without special tokens, then ``end_id``; a
    null or empty text has the end id alone. ``loss`` names a column of code point ranges,
    array<struct<start, stop>>: a token bears loss where its first character is in one, the
    end id where the text's last character is; null and empty lists bear none. Without it all
    tokens bear loss. Each id lies in one piece; pieces of a sequence lie side by side from
    offset 0, and no sequence exceeds a limit. sequence_id is the task's number times 2^32 plus
    the count in the task. Repeated rows are packed as often as they occur, a null doc_id
    stays null, and other columns are not read. Empty in, empty out.
    """
    spans = F.lit(None).cast("array<struct<start:long,stop:long>>")
    if loss:
        spans = F.transform(loss, lambda x: F.struct(x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), spans.alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokens = _Packer(limits, TaskContext.get().partitionId() << 32), word_tokens(tokenizer, bool(loss))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        counted = np.arange(1 << 16)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.out)) if packer.out else [[]] * len(names)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=names)

        tail = np.array([end_id], np.uint32)
        for batch in batches:
            texts = batch.column(1)
            marks = batch.column(2).to_pylist() if loss else [None] * batch.num_rows
            chars = pc.utf8_length(texts).fill_null(0).to_pylist() if loss else marks
            for doc, (ids, starts), mark, size in zip(batch.column(0).to_pylist(), tokens.encode(*utf8(texts)), marks, chars):
                ids = np.concatenate([ids, tail])
                if loss:
                    before = _loss_before(starts, [(x["start"], x["stop"]) for x in mark or ()], size)
                else:
                    while len(ids) >= len(counted):
                        counted = np.arange(2 * len(counted))
                    before = counted[: len(ids) + 1]
                packer.add(doc, ids, before)
                packer.drain()
                if len(packer.out) > 10_000:
                    yield flush()
        packer.finish()
        yield flush()
        tokens.shrink()

    return docs.mapInArrow(releasing(run), SCHEMA)
