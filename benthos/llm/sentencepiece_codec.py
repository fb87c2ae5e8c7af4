"""SentencePiece models on the tokenizers library, encoding and decoding in batches.

The model file's protobuf is read field by field: pieces with scores and types, trainer and
normaliser settings. From them a tokenizer is rebuilt: the precompiled character map, the
dummy prefix and the metaspace marker as normalisers, and the model proper. A unigram model
takes the scores as they are. A BPE model ranks merges by the merged piece's score; every
split of a piece into two known pieces is a merge. Byte pieces give the byte fallback.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """What the file says; names follow the format's own fields."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    byte_fallback: bool = False

    @classmethod
    def read(cls, path: str) -> PieceModel:
        out = cls()
        with open(path, "rb") as f:
            whole = f.read()
        for number, value in _fields(whole):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                out.model_type, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                n = dict(_fields(value))
                out.charsmap, out.add_dummy_prefix = n.get(2, b""), bool(n.get(3, 1))
                out.remove_extra_whitespaces, out.escape_whitespaces = bool(n.get(4, 1)), bool(n.get(5, 1))
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Splits of each piece into two usable pieces, best merged piece first."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = [(-self.pieces[i][1], i, usable[p[:k]], usable[p[k:]], p[:k], p[k:]) for p, i in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        return [(a, b) for *_, a, b in sorted(found)]

    def words_stay_apart(self) -> bool:
        """No piece has the marker after another character: text may be cut before a run of markers."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def build(model: PieceModel):
    """The tokenizer of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.model_type == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, model.merges(), unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models have pieces to rebuild")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if model.words_stay_apart():
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    own = [AddedToken(p, normalized=True) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens(own)
    return t


class Codec:
    """Encodes and decodes batches of texts, on as many threads as the process has cores.

    Where no piece crosses the border before a marker, and the normaliser does nothing but
    mark, a text's ids are those of its marked words in order; each distinct word is then
    encoded once and kept. The cache is emptied at ``most`` words. Line feeds are cut off as
    well where they can only be bytes. Other models encode whole texts.
    """

    def __init__(self, model: PieceModel, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.tokenizer, self.most, self.kept, self.pattern = build(model), most, {}, None
        self.strip = model.add_dummy_prefix
        self.raw = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind == NORMAL else None for p, _, kind in model.pieces]
        if model.words_stay_apart() and not (model.charsmap or model.remove_extra_whitespaces) and model.escape_whitespaces and not any(kind == USER_DEFINED for *_, kind in model.pieces):
            alone = model.byte_fallback and not any("\n" in p for p, _, kind in model.pieces if kind == NORMAL)
            line, other = ("\n|", "\n") if alone else ("", "")
            self.pattern = re.compile(f"{line}{MARK}+[^{MARK}{other}]*|[^{MARK}{other}]+")
            self.prefix = MARK if model.add_dummy_prefix else ""
            bare = dataclasses.replace(model, add_dummy_prefix=False)
            self.words = build(bare)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.pattern is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self.pattern.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.kept) > self.most:
            self.kept.clear()
        new = list({w for words in cut for w in words if w not in self.kept})
        self.kept.update(zip(new, (e.ids for e in self.words.encode_batch_fast(new, add_special_tokens=False))))
        get = self.kept.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Bytes of the pieces, joined; the library decodes what is not plain pieces in valid UTF-8."""
        out, get = [], self.raw.__getitem__
        for own in ids:
            try:
                text = b"".join(map(get, own)).decode()
                out.append(text[1:] if self.strip and text[:1] == " " else text)
            except (TypeError, UnicodeDecodeError):
                out.append(self.tokenizer.decode(own, skip_special_tokens=False))
        return out


@functools.lru_cache(2)
def load(path: str) -> Codec:
    return Codec(PieceModel.read(path))


SCHEMA = "doc_id long, n_tokens long, ids array<int>"
BATCH_CHARS = 2_000_000


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids) per row of (doc_id, text), without special tokens.

    Null counts as empty, and an empty text has no ids. Control pieces in a text are plain
    text. Repeated rows are encoded each, other columns are not read. Empty in, empty out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1).to_pylist()):
                ids = tokenizer.encode(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
                at += len(part)

    return docs.mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) per row of (doc_id, ids); null ids count as none, a null id is an error of the input's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)
        for batch in batches:
            texts = tokenizer.decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_chars, same) per row: encoded, decoded and held against the text.

    ``same`` says that decoding the ids gives the text back. Null and empty texts have no
    ids and are the same. ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    import numpy as np

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1).to_pylist()):
                ids = tokenizer.encode(part)
                back = tokenizer.decode(ids)
                cols = [pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids], pa.int64()), pa.array(map(len, back), pa.int64()), pa.array([a == b for a, b in zip(part, back)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *cols], names=["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "same"])
                at += len(part)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, same boolean")
