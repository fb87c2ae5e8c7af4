"""Chat formatting with loss masks found by rendering successive prefixes of a conversation.

The template is a black box: a function of the turns so far. For each turn the prefix of the
conversation that ends with it is rendered and compared with the previous output. If that
output is a prefix of the new one, the rest is the turn's span; if not, the template rewrote
history, which is reported with the turn that caused it. The text's place in the span comes from two further
renderings: the prefix with the turn's header left open, and the prefix with an empty text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn], str | None], str]

# The control strings of the default template.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"

_CONTROL = re.compile(r"\\|" + "|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in (BEGIN, END, OPEN, CLOSE)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(rf"{re.escape(BEGIN + OPEN)}(.*?){re.escape(CLOSE)}(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    """A backslash goes before each backslash and after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@functools.lru_cache(1024)
def _header(role: str) -> str:
    return f"{BEGIN}{OPEN}{escape(role)}{CLOSE}"


@functools.lru_cache(8192)  # successive prefixes repeat their turns
def _rendered(role: str, text: str) -> str:
    return f"{_header(role)}{escape(text)}{END}\n"


def default_template(turns: list[Turn], open_role: str | None = None) -> str:
    """``<s>[INST]role[/INST]text</s>`` and a line feed per turn; open_role appends a header."""
    out = "".join([_rendered(r, t) for r, t in turns])
    return out if open_role is None else out + _header(open_role)


def parse_default(formatted: str) -> list[Turn]:
    """The turns that default_template rendered."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


Span = tuple[int, int, int, int]


def _turn(turns: list[Turn], k: int, before: str, out: str, template: Template) -> tuple[int, Span, bool]:
    """Where turn k starts to differ from ``before``, its span in ``out``, and whether it rewrote history."""
    role, start, rewrote = turns[k][0], len(before), not out.startswith(before)
    if rewrote:
        lo, hi = 0, min(len(before), len(out))
        while lo < hi:  # longest common prefix, by halves
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before[:mid] == out[:mid] else (lo, mid - 1)
        start = lo
    header = template(turns[:k], role)
    at = len(header) if out.startswith(header) else start
    size = len(out) - len(template([*turns[:k], (role, "")], None))
    return start, (start, len(out), at, max(at, min(len(out), at + size))), rewrote


def spans(turns: list[Turn], template: Template) -> tuple[str, list[Span], list[int]]:
    """Full output; per turn (start, end, text start, text end); turns that rewrote history.

    Every prefix is rendered, whatever the template and however long the conversation, and each
    output is compared with the one before. A turn that rewrote what came before has its span
    from the first changed character on, and earlier spans reach no further than that; nothing
    is taken on trust, so a rewrite that a later turn undoes is reported as well, as two. The
    characters rendered grow with the square of the conversation's length.
    """
    before, found, rewrites = template([], None), [], []
    for k in range(len(turns)):
        out = template(turns[: k + 1], None)
        start, span, rewrote = _turn(turns, k, before, out, template)
        if rewrote:
            rewrites.append(k)
            found = [tuple(min(x, start) for x in s) for s in found]
        found.append(span)
        before = out
    return before, found, rewrites


SCHEMA = "conv_id long, n_turns long, formatted string, roles array<string>, spans array<struct<start:long,stop:long,text_start:long,text_stop:long>>, rewrites array<long>"


def format_conversations(rows: DataFrame, template: Template = default_template) -> DataFrame:
    """One row per conversation: text, the role and span of each turn, rewritten turns.

    Input (conv_id, turn, role, text), one row per turn in the order of turn; ties are put in
    order of role and text, a null turn comes first, repeated rows are turns of their own. A
    null role or text counts as empty; rows with null conv_id form one conversation. Other
    columns are not read. A task holds one conversation at a time. Empty in, empty out.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, ready, chars = object(), [], [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*ready)) if ready else [[]] * 6
            ready.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "text_start", "text_stop")])), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["conv_id", "n_turns", "formatted", "roles", "spans", "rewrites"])

        def done() -> None:
            out, at, rewrites = spans(turns, template)
            ready.append((conv, len(turns), out, [r for r, _ in turns], [dict(zip(("start", "stop", "text_start", "text_stop"), s)) for s in at], rewrites))

        for batch in batches:
            for c, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if c != conv:
                    if turns:
                        done()
                        chars += len(ready[-1][2])
                        if chars > 1 << 22:
                            yield flush()
                            chars = 0
                    conv, turns = c, []
                turns.append((r, t))
        if turns:
            done()
        yield flush()

    return dealt.mapInArrow(run, SCHEMA)


def chat_digests(formatted: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """What the formatted text of the default template and its spans say, read back from them."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, text, roles, at in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "roles", "spans"))):
                turns = parse_default(text)
                loss = unescape("".join(text[s["text_start"] : s["text_stop"]] for r, s in zip(roles, at) if r == learn_role))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((c, len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
