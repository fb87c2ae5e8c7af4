"""Runs of repeated words against brute force over all periods."""

import random
import zlib
from hashlib import sha256

import pytest

from benthos.llm import periodic
from tests.llm.test_llm import WORD, docs_frame


def brute_runs(w, least=12):
    """Runs by comparing all words at all distances; a distance with a smaller period is none."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                s = w[i : i + length]
                if not any(s[r:] == s[: length - r] for r in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def test_runs_of_random_words():
    rnd = random.Random(3)
    for _ in range(400):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(0, 50))]
        p, a = rnd.randint(1, 12), rnd.randint(0, 10)
        for words in (w, [x if i < a + p else w[a + (i - a) % p] for i, x in enumerate(w)]):
            for least in (2, 7, 12):
                assert periodic.find_runs(words, least) == brute_runs(words, least)


def test_fibonacci_word_is_rich_in_runs():
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    assert periodic.find_runs(b, 2) == brute_runs(b, 2) and len(periodic.find_runs(b, 2)) > 100


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    vocab = [f"w{i}ö" for i in range(40)] + ["averylongwordthatistoolongforonelane" * 3]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    out = [None, "", " \t\n", "one", "a " * 12, "a " * 11, "\n".join(["the same line"] * 5), "x y z " * 4 + "x"]
    for i in range(120):
        w = make(rnd.randint(5, 90))
        if i % 3 == 0:
            at, p = rnd.randrange(len(w)), rnd.randint(1, 15)
            w[at:at] = (make(p) * 5)[: rnd.randint(p, 5 * p)]
        out.append(rnd.choice([" ", "\n", "  "]).join(w))
    out.append(" ".join(make(700) * 3) + " tail")
    return [(i * 7919, t) for i, t in enumerate(out)] + [(None, "k " * 30), (0, None)]


def test_rows_and_digests(spark, texts):
    from pyspark.sql import functions as F

    docs = docs_frame(spark, texts).repartition(3)
    found = periodic.periodic_runs(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    want = []
    for i, t in texts:
        w = WORD.findall(t or "")
        runs = brute_runs(w)
        want.append((i, len(w), runs, brute_collapsed(w, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(docs.where("doc_id < 0")).count() == 0

    edited = docs.select("doc_id", periodic.repeat_passages(F.col("text"), F.col("doc_id")).alias("text"), F.lit(1).alias("runs"))
    got = periodic.run_digests(periodic.periodic_runs(edited)).collect()
    want, planted = [], 0
    for i, t in texts:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n, planted = h // 10, len(w), planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha256(told.encode()).hexdigest(), sha256(brute_collapsed(w, runs).encode()).hexdigest()))
    assert planted > 5
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[7])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
