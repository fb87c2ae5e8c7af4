"""Best-two-fit packing against the rule run piece by piece, and against the tokenizer on whole texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from benthos.llm import best_fit
from benthos.llm.queries import tokenizer_path
from benthos.llm.text import utf8
from tests.llm.test_llm import docs_frame

ODD = ["   \n b", "a　 b", "a \nb", "x  y\t\tz ", " lead", "it's  we'll\n\n don't", "<|endoftext|> a<|endoftext|>b", "é 中文 字 1234 a1b2", "a\x1f b\x85 c  d", "\n", "a   b", "x" * 3000]


def slow_bins(pieces, limit):
    """Bins made one at a time from a list of waiting pieces."""
    left, bins = sorted(pieces, reverse=True), []
    while left:
        one, gap = [], limit
        for x in list(left):
            if x <= gap:
                one.append(x)
                left.remove(x)
                gap -= x
        least = min(one)
        best = max(((x + y, x, y) for i, x in enumerate(left) for y in left[i + 1 :] if least < x + y <= least + gap), default=None)
        if best:
            one.remove(least)
            left.append(least)
            for x in best[1:]:
                one.append(x)
                left.remove(x)
            left.sort(reverse=True)
        bins.append(tuple(sorted(one)))
    return Counter(bins)


def lower_bound(counts, limit):
    """No packing has fewer bins: pieces over half a bin do not share one, and small ones fill what they leave."""
    best = 0
    for k in range(limit // 2 + 1):
        big = sum(n for s, n in counts.items() if s > limit - k)
        mid = [(s, n) for s, n in counts.items() if limit / 2 < s <= limit - k]
        room = sum(n * (limit - s) for s, n in mid)
        small = sum(s * n for s, n in counts.items() if k <= s <= limit / 2)
        best = max(best, big + sum(n for _, n in mid) + max(0, -((room - small) // limit)))
    return best


def test_bins_in_bulk_are_those_of_single_pieces():
    rnd = random.Random(4)
    for _ in range(300):
        limit = rnd.choice([5, 16, 40])
        pieces = [rnd.randint(1, limit) if rnd.random() < 0.7 else rnd.choice([1, limit // 3 + 1, limit]) for _ in range(rnd.randint(0, 60))]
        got = Counter()
        for one, many in best_fit.best_two_fit(Counter(pieces), limit):
            assert many > 0 and sum(s * n for s, n in one.items()) <= limit
            got[tuple(sorted(s for s, n in one.items() for _ in range(n)))] += many
        assert got == slow_bins(pieces, limit)
    with pytest.raises(ValueError):
        best_fit.best_two_fit({9: 1}, 8)


def test_two_smaller_pieces_replace_the_smallest():
    # 6 + 3 leaves 1 of 10; 2 + 2 fits what 3 leaves exactly
    assert best_fit.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]


def test_different_bins_are_few():
    rnd = np.random.default_rng(2)
    for counts in ({s: int(n) for s, n in enumerate(rnd.integers(1, 10**9, 1024), 1)}, {s: int(n) for s, n in enumerate(rnd.geometric(0.2, 1024), 1)}):
        bins = best_fit.best_two_fit(counts, 1024)
        assert len(bins) <= sum(1 + 1024 // s for s in counts) and len(best_fit.places(bins)) < 50_000
        used = Counter()
        for one, many in bins:
            for s, n in one.items():
                used[s] += n * many
        assert used == counts
        fewest = sum(many for _, many in best_fit.fewest_bins(counts, 1024))
        assert fewest <= sum(many for _, many in bins) <= 1.001 * lower_bound(counts, 1024) + 2


def test_ids_are_those_of_whole_texts():
    tokens = best_fit.SpacedTokens(tokenizer_path("byte_bpe_50k.json"))
    assert tokens.by_word
    rnd = random.Random(6)
    bits = ["a", "Bc", "é", "中", "'s", " ", "  ", "\n", "\t", " ", "　", "\x85", "\x0b", "​", "12", "!?", "<|endoftext|>", " "]
    texts = ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    got = [ids.tolist() for ids, _ in tokens.encode(*utf8(pa.array(texts)))]
    assert got == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # a cache that overflows keeps what comes again, and changes no id
    small = best_fit.SpacedTokens(tokenizer_path("byte_bpe_50k.json"), most=40)
    for part in (texts[:700], texts[300:900], texts[:50]):
        assert [ids.tolist() for ids, _ in small.encode(*utf8(pa.array(part)))] == [small.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        small.shrink()
        assert len(small.number) <= 20 and small.used == small.size[: len(small.number)].sum()
    big = best_fit.SpacedTokens(tokenizer_path("byte_bpe_50k.json"))
    for _ in range(2):
        for _ in range(2):
            assert [ids.tolist() for ids, _ in big.encode(*utf8(pa.array(texts)))] == got
        big.shrink()
    assert big.number and [ids.tolist() for ids, _ in big.encode(*utf8(pa.array(texts[:99])))] == got[:99]
    # a tokenizer whose spaces are dropped encodes whole texts here
    other = best_fit.SpacedTokens(tokenizer_path("word_bpe_49k.json"))
    assert not other.by_word and [x.tolist() for x, _ in other.encode(*utf8(pa.array(ODD)))] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]


def test_packed_pieces(spark):
    rnd = random.Random(7)
    texts = [None, "", "a"] + ODD + [" ".join(rnd.choice(["alpha", "beta", "gämma", "delta;"]) for _ in range(int(rnd.expovariate(0.01)))) for _ in range(150)]
    texts += ["tok " * 2047, "tok " * 1023, "tok " * 1024, "tok " * 5000] + ["same text twice"] * 2
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "again three")]
    docs = docs_frame(spark, rows).repartition(3)
    tokenizer = best_fit.SpacedTokens(tokenizer_path("byte_bpe_50k.json")).tokenizer
    found = best_fit.best_fit(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 1024
    counts = Counter(r.length for r in found)
    assert len(bins) <= sum(slow_bins(counts.elements(), 1024).values()) and len(bins) <= lower_bound(counts, 1024) + 2
    assert sorted(bins) == list(range(len(bins)))
    assert best_fit.best_fit(docs.where("doc_id < 0"), tokenizer_path("byte_bpe_50k.json")).count() == 0
