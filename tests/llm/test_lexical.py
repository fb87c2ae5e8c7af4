"""Ranked lexical search against scores of all documents for all items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from benthos.llm import lexical
from benthos.llm.text import utf8
from tests.llm.test_llm import docs_frame

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, top):
    counted = [(i, Counter(brute_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            if c:
                m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in brute_terms(text) if c[t])
                if score > 0:
                    scores.append((-score, i is None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return out


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, rank int")


def sample(seed=11, n=400):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + [f"Rare{i}é" for i in range(400)] + ["中文", "x1", "longterm" * 20]
    make = lambda n: "".join(rnd.choice(vocab[:30] if rnd.random() < 0.8 else vocab) + rnd.choice([" ", ", ", "-", "\n", "_"]) for _ in range(n))
    docs = [(i, make(int(rnd.expovariate(0.02)))) for i in range(n)]
    passage = make(25)
    docs += [(1000 + i, passage + make(5)) for i in range(30)] + [(2000 + i, passage) for i in range(40)]
    docs += [(3000, None), (3001, ""), (3002, " ,;-"), (3003, "w1 " * 5000), (3004, make(20_000)), (3005, "w1"), (None, passage), (None, make(30)), (5, passage), (2000, passage)]
    items = [(0, passage), (1, "w1"), (2, "w1 w1 W1 w2"), (3, "Rare7é and RARE9É"), (4, None), (5, "?!"), (6, "nowhere else"), (7, make(300)), (8, "longterm" * 20), (9, docs[3][1]), (9, "w5 w6")]
    return docs, items


def test_ranks(spark, monkeypatch):
    docs, items = sample()
    frame = docs_frame(spark, docs).repartition(3)
    want = sorted(brute_ranks(docs, items, 10), key=str)
    assert sorted(map(tuple, lexical.rank_documents(frame, items_frame(spark, items)).collect()), key=str) == want
    # blocks of eight, bitmaps of few terms at a time, documents joined by a shuffle, queries in rounds
    for name, value in (("BLOCK", 8), ("TERMS_AT_ONCE", 7), ("BROADCAST_ROWS", -1), ("QUERY_CHARS", 600)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.rank_documents(frame, items_frame(spark, items)).collect()), key=str) == want


def test_empty_tables(spark):
    docs, items = docs_frame(spark, [(1, "a b"), (2, "b")]), items_frame(spark, [(0, "a"), (1, "b")])
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, items, top=1).orderBy("item_id").collect()] == [(0, 1, 1), (1, 1, 2)]
    assert lexical.rank_documents(docs.where("doc_id < 0"), items).count() == 0
    assert lexical.rank_documents(docs, items.where("item_id < 0")).count() == 0
    assert lexical.rank_documents(docs_frame(spark, [(1, None)]), items_frame(spark, [(0, None)])).count() == 0


def test_bounds_are_never_below_the_score_and_exclude_most(spark):
    docs, items = sample(12, 600)
    frame = docs_frame(spark, docs).repartition(2)
    terms = sorted({t for _, x in items for t in brute_terms(x)})
    index = lexical.build_index(frame, terms).collect()
    stats = [r for r in index if r.held is not None]
    counted = [Counter(brute_terms(t)) for _, t in docs]
    df = np.sum([r.held for r in stats], axis=0)
    assert df.tolist() == [sum(1 for c in counted if c[t]) for t in terms]
    assert sum(r.filled for r in stats) == sum(1 for c in counted if c) and sum(r.total for r in stats) == sum(map(lambda c: sum(c.values()), counted))
    number = {t: k for k, t in enumerate(terms)}
    weighted = []
    for _, text in items:
        own = Counter(number[t] for t in brute_terms(text))
        weighted.append((np.array(sorted(own), np.int64), np.array([own[k] * (k % 7 + 1) for k in sorted(own)], np.int64)))
    queries = lexical.Queries(terms, weighted, sum(r.filled for r in stats), sum(r.total for r in stats))
    hashes = lexical.Terms(*utf8(pa.array([" ".join(terms)]))).hash
    texts, seen, loose = dict(docs), 0, 0
    for r in index:
        if r.slices is None:
            continue
        slices = np.frombuffer(r.slices, np.uint8).reshape(r.width, -1)
        bounds = lexical.upper_bounds(slices, np.array(r.sizes), queries, hashes)
        for d, (doc, n) in enumerate(zip(r.doc_ids, r.sizes)):
            if doc is None or doc in (5, 2000):
                continue
            c, m = Counter(brute_terms(texts[doc])), int(queries.mass(np.array([n]))[0])
            for i, (at, w) in enumerate(weighted):
                exact = sum(int(x) * (10**9 * c[terms[k]] // (1000 * c[terms[k]] + 8 * m)) for k, x in zip(at.tolist(), w))
                assert bounds[i, d] >= exact
                seen, loose = seen + 1, loose + (bounds[i, d] > 1.1 * exact + 1)
    assert seen > 5000 and loose < 0.05 * seen
