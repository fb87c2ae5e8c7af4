"""The ten operators and the pipeline against brute force, on small fixtures and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from benthos.llm import chat, exact_dedup, fingerprints, html_text, language_model, licenses, near_dedup, packing, quality, sentencepiece_codec
from benthos.llm.queries import tokenizer_path
from benthos.llm.text import Words, shingle_sets, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kept int, score string"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def docs_frame(spark, texts):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", None, None, "x", 7, "s") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefgö") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = [make(rnd.randint(30, 80)) for _ in range(12)]
    out = list(base)
    for b in base[:6]:
        w = b.split(" ")
        for _ in range(4):
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = make(1)
            out.append(" ".join(v))
    out += [base[0].upper(), base[1].replace(" ", "\n"), base[2] + "  ", "", None, " \t", "one", "ONE", "two words", "a b c", make(30_000), "ab c 😀 \x1f"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_frame(spark, texts)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_words_and_shingles(texts):
    import pyarrow as pa

    data, off = utf8(pa.array([t for _, t in texts], pa.string()))
    w = Words(data, off)
    raw = w.bytes.tobytes()
    got = defaultdict(list)
    for r, a, z in zip(w.row, w.start, w.end):
        got[int(r)].append(raw[a:z].decode())
    assert all(got[i] == words_of(t) for i, t in texts)
    assert len({h for h in w.hash.tolist()}) == len({x for _, t in texts for x in words_of(t)})
    for (_, t), s in zip(texts, shingle_sets(data, off, 3)):
        ws = words_of(t)
        assert len(s) == len({tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} or ({tuple(ws)} if ws else set()))


# ---- 1 ------------------------------------------------------------------------------------


def test_sentencepiece_parity(spark, texts, docs, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  two  spaces ", "a\tb\nc\n\n", "</s> <s>", "<0x0A> é ﬁ 😀▁x", " ", "▁", "x" * 3000]
    own = docs.unionByName(docs_frame(spark, [(1000 + i, t) for i, t in enumerate(odd)]))
    all_texts = dict(texts) | {1000 + i: t for i, t in enumerate(odd)}
    encoded = sentencepiece_codec.encode(own, path)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: sp.encode(t or "") for i, t in all_texts.items()}
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded, path).collect()}
    assert back == {i: sp.decode(got[i]) for i in got}
    codec = sentencepiece_codec.load(path)
    broken = [[300, 229], [229, 132, 300], [1, 300, 2], [], [259]]
    assert codec.decode(broken) == codec.tokenizer.decode_batch(broken, skip_special_tokens=False)
    assert sentencepiece_codec.encode(empty, path).count() == 0
    from benthos.llm import queries

    table_rows = {r.doc_id: r for r in sentencepiece_codec.round_trips(own.unionByName(own.where("doc_id = 3")), path).collect()}
    assert set(table_rows) == set(all_texts) and sentencepiece_codec.round_trips(own, path).count() == len(all_texts)
    assert queries.op1_sentencepiece.__doc__


def test_unigram_model_is_rebuilt(tmp_path):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def field(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    import struct

    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("b", -2.5, 1), ("ab", -2.0, 1), ("a", -3.0, 1), ("c", -3.5, 1), ("bc", -3.1, 1)]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    body += field(2, varint(3 << 3) + varint(1)) + field(3, field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    path = tmp_path / "u.model"
    path.write_bytes(body)
    model = sentencepiece_codec.PieceModel.read(str(path))
    assert model.model_type == sentencepiece_codec.UNIGRAM and [p for p, _, _ in model.pieces] == [p for p, _, _ in pieces]
    codec, sp = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_file=str(path))
    sample = ["ab abc", "cab", "a", "", "bbcc ab"]
    assert codec.encode(sample) == sp.encode(sample)


# ---- 2 ------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<s>\\\\[INST]", "<\\s>", None, "", "<</s>s>", "[[INST]"]
    rows = [(1, i, ["user", "assistant", "sys<s>"][i % 3], t) for i, t in enumerate(nasty)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, None, None), (None, 1, "user", "u")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    want = defaultdict(list)
    for c, _, r, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] or 0)):
        want[c].append((r or "", t or ""))
    for c, r in made.items():
        assert chat.parse_default(r.formatted) == want[c] and not r.rewrites and r.n_turns == len(want[c])
        assert [chat.unescape(r.formatted[s.text_start : s.text_stop]) for s in r.spans] == [t for _, t in want[c]]
        inner = [r.formatted[s.text_start : s.text_stop] for s in r.spans]
        assert not any(k in x for x in inner for k in ("<s>", "</s>", "[INST]", "[/INST]"))
    d = {r.conv_id: r for r in chat.chat_digests(chat.format_conversations(df)).collect()}
    loss = "".join(t for r, t in want[1] if r == "assistant")
    assert d[1].loss_sha256 == sha256(loss.encode()).hexdigest() and d[1].loss_chars == len(loss)
    assert d[1].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in want[1]).encode()).hexdigest()
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_template_that_rewrites_history():
    def forgetful(turns, open_role=None):
        shown = turns[-2:] if len(turns) > 2 else turns
        return "".join(f"{r}:{t};" for r, t in shown) + (f"{open_role}:" if open_role else "")

    _, _, rewrites = chat.spans([("u", "a"), ("a", "b"), ("u", "c"), ("a", "d")], forgetful)
    assert rewrites == [2, 3]


def brute_rewrites(turns, template):
    made = [template(turns[:k], None) for k in range(len(turns) + 1)]
    return [k for k in range(len(turns)) if made[k + 1][: len(made[k])] != made[k]]


def summary(turns, open_role=None):
    """A line in front while there are five to eight turns: written by the fifth, taken back by the ninth."""
    front = "SUMMARY\n" if 5 <= len(turns) <= 8 else ""
    return front + "".join(f"{r}:{t};" for r, t in turns) + (f"{open_role}:" if open_role is not None else "")


def test_chat_rewrites_are_found_at_any_length():
    def numbered(turns, open_role=None):
        return "BOS" + "".join(f"{i}{r}:{t};" for i, (r, t) in enumerate(turns)) + (f"{len(turns)}{open_role}:" if open_role is not None else "")

    def last_marked(turns, open_role=None):
        return "".join(f"{r}:{t}{'!' if i == len(turns) - 1 else ';'}" for i, (r, t) in enumerate(turns)) + (f"{open_role}:" if open_role is not None else "")

    def nine(turns, open_role=None):
        return "".join(f"{r}:{t};" for r, t in turns[-9:]) + (f"{open_role}:" if open_role is not None else "")

    rnd = random.Random(1)
    for n in (0, 1, 3, 7, 30):
        turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["", "</s>x", "a b", "\\"])) for _ in range(n)]
        for template in (chat.default_template, numbered, last_marked, nine, summary):
            out, found, rewrites = chat.spans(turns, template)
            assert out == template(turns, None) and len(found) == n and rewrites == brute_rewrites(turns, template)
            assert all(0 <= a <= x <= y <= z <= len(out) or a == z for a, z, x, y in found)
    turns = [("u", str(i)) for i in range(10)]
    out, found, rewrites = chat.spans(turns, summary)
    assert rewrites == [4, 8] and [out[x:y] for _, _, x, y in found][9:] == ["9"]


def test_chat_long_conversations(spark):
    turns = [("user", f"x{i % 50}") for i in range(2000)]
    out, found, rewrites = chat.spans(turns, chat.default_template)
    assert not rewrites and [out[x:y] for _, _, x, y in found] == [t for _, t in turns]
    late = lambda turns, role=None: chat.default_template(turns[1:] if len(turns) == 1500 else turns, role)
    assert chat.spans(turns, late)[2] == [1499, 1500]
    rows = [(1, i, "user", "long " * 200_000 if i == 1 else "x") for i in range(40)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert made.n_turns == 40 and not made.rewrites and len(made.formatted) > 1_000_000


# ---- 3 ------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(texts, docs, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, near_dedup.NearDedup(shingle=k, threshold=percent)).collect()}
    assert got == brute_components(texts, k, percent)


def test_near_duplicates_chain_across_stars(spark):
    """Copies that drift: each is close to the one before it only."""
    rnd = random.Random(8)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        rows.append((30 - i, " ".join(w)))
        w[rnd.randrange(120)] = f"n{i}"
        w[rnd.randrange(120)] = f"m{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_frame(spark, rows), near_dedup.NearDedup(shingle=3, threshold=85)).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_odd_rows(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = docs_frame(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


def test_collision_correction():
    spec = near_dedup.NearDedup()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)])
    ra, rb = near_dedup.registers(np.unique(a), spec)[0], near_dedup.registers(np.unique(b), spec)[0]
    n = np.array([3000.0])
    assert near_dedup.corrected_jaccard(ra[None], rb[None], n, n, spec)[0] == pytest.approx(2400 / 3600, abs=0.09)
    bands, r = near_dedup.NearDedup(threshold=85).banding
    assert (1 - 0.85**r) ** bands <= 1e-8


# ---- 4 ------------------------------------------------------------------------------------


def test_exact_duplicates(texts, docs, empty):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        want |= {i: (keep, len(members), i == keep, sha256(norm.encode()).hexdigest()) for _, i in members}
    for capacity in (100_000, 2, 1):
        rows = exact_dedup.exact_duplicates(docs, capacity).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want
        held = defaultdict(set)
        for r in rows:
            held[r.bucket].add(r.text_sha256)
        # the directory places texts: no bucket holds more than its capacity, and there are as many as that needs
        assert max(map(len, held.values())) <= capacity and len(held) >= len(groups) / capacity
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_null_ids(spark):
    rows = docs_frame(spark, [(None, "a  b"), (5, "ab"), (-3, "a b"), (-3, "a b")])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect()), key=str)
    assert got == [(-3, None, 4, False), (-3, None, 4, False), (5, None, 4, False), (None, None, 4, True)]


def test_directory_doubles_where_buckets_overflow(spark):
    keys = spark.createDataFrame([((i << 56) - (1 << 64 if i > 127 else 0),) for i in [0, 1, 2, 3, 128]], "key long")
    slots, depth = exact_dedup.directory(keys, 2)
    got = {r.slot: (r.bucket, r.local_depth) for r in slots.collect()}
    assert depth == 8 and len(got) == 132 and got[128] == got[255] == (128, 1) and got[0] == got[1] == (0, 7) and got[2] == got[3] == (2, 7)
    assert exact_dedup.directory(keys, 9)[0].first().local_depth == 0


def test_hot_texts_are_split_over_owners(spark, monkeypatch):
    rows = docs_frame(spark, [(i, "the same  text" if i % 2 else f"text {i}") for i in range(4000)])
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(rows, 100).collect()}
    assert all(got[i].keep_id == 1 and got[i].group_size == 2000 for i in range(1, 4000, 2)) and all(got[i].group_size == 1 for i in range(0, 4000, 2))


# ---- 5 ------------------------------------------------------------------------------------


def test_quality_learns_and_scores_all(spark):
    rnd = random.Random(2)
    clean = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    junk = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) + rnd.choice(["***", "###"]) for _ in range(40))
    rows = [(i, clean() if i % 3 else junk()) for i in range(240)]
    docs = docs_frame(spark, [*rows, (900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(200)] + [(None, 1, 0), (3, None, 0), (77, 5, 0)], "doc_id long, quality int, toxic int")
    spec = quality.QualitySpec(sample=100, epochs=6)
    model = quality.train(docs, labels, spec)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(200, 240)) and len(got) == 243
    assert got[900].score == got[901].score == pytest.approx(134 / 202, abs=0.01)
    kept = {r.doc_id for r in quality.select_kept(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}
    # ids that repeat a hundred times send one row each to the driver
    import unittest.mock

    with unittest.mock.patch.object(quality, "fit", side_effect=lambda keys, *_: len(keys)):
        again = docs.where("doc_id < 4").crossJoin(spark.range(100).select(F.lit(1).alias("again")))
        assert quality.train(again, labels.where("doc_id < 4"), quality.QualitySpec(sample=2)) == 4
    # labels without a document use up neither the sample nor the shares
    lost = labels.unionByName(spark.createDataFrame([(10_000 + i, 1, 0) for i in range(2000)], labels.schema))
    seen = []
    with unittest.mock.patch.object(quality, "fit", side_effect=lambda keys, counts, y, share, spec: seen.append((sorted(y.tolist()), share))):
        quality.train(docs, lost, quality.QualitySpec(sample=20))
    assert seen == [([0] * 20 + [1] * 20, {0: 67, 1: 133})]
    assert quality.score(docs.where("false"), model).count() == 0 and quality.select_kept(docs.where("false"), model).count() == 0
    untaught = quality.train(docs, labels.where("false"), spec)
    assert {r.score for r in quality.score(docs, untaught).collect()} == {0.5}


def slow_features(text, spec):
    """Buckets of a text's words, word pairs and n-grams, one at a time, with the hashes of single units."""
    from benthos.llm.text import combine, mix

    import pyarrow as pa

    one = lambda w: Words(*utf8(pa.array([w])), lower=False).hash[:1]
    bucket = lambda h, n: int(mix(h + np.uint64(n))[0]) % 2**64 >> (64 - spec.buckets.bit_length() + 1)
    out, words = [], WORD.findall(text or "")
    for units, sizes in (([one(w) for w in words], range(1, spec.words + 1)), ([mix(np.array([ord(c) + 1], np.uint64)) for c in text or ""], spec.grams)):
        for n in sizes:
            for i in range(len(units) - n + 1):
                h = units[i]
                for u in units[i + 1 : i + n]:
                    h = combine(h, u)
                out.append(bucket(h, n))
    return out


def test_quality_scores_feature_by_feature(spark, texts):
    spec = quality.QualitySpec(buckets=1 << 10, dim=3, sample=50, epochs=2)
    rng = np.random.default_rng(4)
    model = quality.QualityModel(rng.normal(size=(spec.buckets, 3)).astype(np.float32), rng.normal(size=(3, 2)).astype(np.float32), np.array([0.3, -0.1], np.float32), spec)
    some = [(i, t if t is None or len(t) < 2000 else t[:500]) for i, t in texts]
    got = {r.doc_id: r for r in quality.score(docs_frame(spark, some), model).collect()}
    for i, t in some:
        f = slow_features(t, spec)
        mean = np.mean([model.vectors[b] for b in f], axis=0) if f else np.zeros(3)
        z = mean @ model.weights + model.bias
        p = np.exp(z - z.max())
        assert got[i].score == pytest.approx(p[1] / p.sum(), abs=1e-5) and got[i].predicted == int(got[i].score >= 0.3)


def test_quality_on_held_out_documents(spark):
    """The area under the curve on documents whose labels were not seen."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    from benthos.llm import queries

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = [(r.score, labels[r.doc_id]) for r in queries.op5_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    assert len(good) > 20 and len(bad) > 5
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97


# ---- 6 ------------------------------------------------------------------------------------


def test_language_model_against_brute_force(texts, docs, empty):
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = {r.doc_id: r for r in language_model.language_model_scores(docs, train, language_model.LmSpec(block_tokens=500, held_out=3)).collect()}
    learnt = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    teaching = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) == 0).collect()} & set(learnt)
    assert 5 < len(teaching) < len(learnt) / 2
    seqs = {i: [*words_of(t), "\0end"] for i, t in texts}

    def counts(ids):
        uni, bi = Counter(), Counter()
        for i in ids:
            uni.update(seqs[i])
            bi.update(zip(["\0start", *seqs[i][:-1]], seqs[i]))
        return uni, bi, sum(uni.values()), lambda u: len(ids) if u == "\0start" else uni[u]

    uni, bi, n, ctx = counts(learnt)
    v = len(uni)
    kept_uni, kept_bi, kept_n, kept_ctx = counts([i for i in learnt if i not in teaching])
    bucket = lambda c: c if c <= 4 else 2 + math.ceil(math.log2(c))
    held = defaultdict(list)
    for i in teaching:
        for u, w in zip(["\0start", *seqs[i][:-1]], seqs[i]):
            c = kept_ctx(u)
            held[bucket(c)].append((kept_bi[u, w] / c if c > 0 else 0.0, kept_uni[w] / kept_n))
    lam = np.zeros((70, 3))
    for b in range(70):
        x = np.array([0.0, 0.6, 0.4]) if b == 0 else np.array([0.4, 0.4, 0.2])
        if b not in held:
            lam[b] = lam[b - 1] if b > 1 else x
            continue
        p = np.array([(a, c, 1 / (v + 1)) for a, c in held[b]])
        for _ in range(200):
            s = p * x
            x = (s / s.sum(1, keepdims=True)).mean(0)
        x = np.maximum(x, [0.0, 1e-6, 1e-6] if b == 0 else 1e-6)
        lam[b] = x / x.sum()
    for i, _ in texts:
        s, r = seqs[i], got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(s), sum(uni[w] > 0 for w in s), n, i not in learnt)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s), rel=1e-9)
        score = 0.0
        for u, w in zip(["\0start", *s[:-1]], s):
            c, m = ctx(u), lam[bucket(ctx(u))]
            score += math.log10(m[0] * (bi[u, w] / c if c else 0) + m[1] * uni[w] / n + m[2] / (v + 1))
        assert r.score == pytest.approx(score, rel=0.004)
    assert language_model.language_model_scores(empty, train).count() == 0


def test_language_model_is_a_distribution():
    """Weights sum to one, so the model sums to one over known words and the unknown."""
    import pandas as pd

    cells = pd.DataFrame({"bucket": [0, 1, 1, 3], "tokens": [5, 4, 4, 9], "p2": [0.0, 1.0, 0.0, 3.0], "p1": [0.1, 0.2, 0.1, 0.4]})
    w = language_model.mixture_weights(cells, 50, 100)
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0 and (w[2] == w[1]).all()
    # a bucket whose held-out tokens all follow their bigrams trusts them, one whose tokens never do does not
    sure = language_model.mixture_weights(pd.DataFrame({"bucket": [1, 2], "tokens": [9, 9], "p2": [9.0, 0.0], "p1": [0.1, 0.9]}), 50, 100)
    assert sure[1, 0] > 0.99 and sure[2, 0] < 0.01
    assert language_model.context_bucket(np.array([0, 1, 2, 3, 4, 5, 8, 9, 16, 17])).tolist() == [0, 1, 2, 3, 4, 5, 5, 6, 6, 7]


def test_words_that_collided_under_a_polynomial_hash(spark):
    """Thue-Morse words of 1,024 characters and their complement differ for every operator."""
    p = "a"
    while len(p) < 1024:
        p += p.translate(str.maketrans("ab", "ba"))
    q = p.translate(str.maketrans("ab", "ba"))
    rows = docs_frame(spark, [(1, f"{p} p q"), (2, f"{q} p q")])
    near = {r.doc_id: r for r in near_dedup.near_duplicates(rows, near_dedup.NearDedup(shingle=3, threshold=85)).collect()}
    assert near[1].kept and near[2].kept and near[2].component_id == 2
    scored = {r.doc_id: r for r in language_model.language_model_scores(rows, F.col("doc_id") == 1).collect()}
    assert (scored[1].n_known, scored[2].n_known) == (4, 3)
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    want = {r.doc_id: [*Tokenizer.from_file(path).encode(r.text, add_special_tokens=False).ids, 2] for r in rows.collect()}
    for r in packing.pack(rows, path).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_words_are_told_apart_where_hashes_are_not(monkeypatch):
    import pyarrow as pa

    from benthos.llm import text as T

    monkeypatch.setattr(T.Words, "_hashes", lambda self: np.zeros(len(self.start), np.uint64))
    monkeypatch.setattr(T.Words, "one_to_one", False)
    long = "x" * 200
    data, off = utf8(pa.array([f"a b a {long}y c", f"a b {long}z c a {long}y"]))
    w = Words(data, off)
    first, back = w.distinct()
    assert [w.text(int(first[i])) for i in back] == [w.text(i) for i in range(len(back))] and len(first) == 5
    sizes, shared = T.shared_shingles(data, off, 2)
    assert sizes.tolist() == [4, 5] and shared.tolist() == [2]


# ---- 7 ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b<br>c", "a\n\nb\nc"),
        ("<div>x</div>y<div>z</div>", "x\ny\nz"),
        ("<ul><li>one<li>two<ol><li>in</ol></ul>", "- one\n- two\n  1. in"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
        ("<table><td>x</table>after", "x\n\nafter"),
        ("a<script>var x='</p>';</script><style>p{}</style>b", "ab"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("a &amp; b &lt;c&gt; 1 < 2", "a & b <c> 1 < 2"),
        ("<!-- no --><b>bold</b> <i>it</i>", "bold it"),
        ("<head><title>t</title></head><body>x", "x"),
        ("", ""), ("<", "<"), ("<p", ""), ("</p></div>", ""), ("<td>lone", "lone"),
    ],
)
def test_html(html, text):
    assert html_text.extract(html).rstrip() == text or html_text.extract(html) == text.strip("\n")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # a head ends where its end tag is left out
        ("<head><title>t</title><p>Hello <b>you</b>", "Hello you"),
        ("<html><head><meta charset=utf-8><script>1</script> \n text <p>more", "text\n\nmore"),
        ("<head><template><p>no</p></template><style>p{}</style></head>x", "x"),
        # whole declarations
        ("<p style='backface-visibility:hidden'>a<p style='x-display:none'>b", "a\n\nb"),
        ("<p style=\"background:url('a;display:none')\">a<p style='display:none;display:block'>b", "a\n\nb"),
        ("<p style='COLOR:red;Display : none !important;display:block'>no<p style='/*;*/visibility:hidden'>no<p>yes", "yes"),
        ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</div>", "yes"),
        ("<div style='content-visibility:hidden'>no</div>x", "x"),
        ("<ul><li style='visibility:hidden'>no</ul>x", "x"),
        # forms, drawings, formulas
        ("Say: <textarea>\na &lt;b&gt;\n  c\n</textarea> end", "Say: a <b>\n  c end"),
        ("<select><option>one<optgroup label=Two><option>three<option label=four>no</select>x", "one\nTwo\nthree\nfour\nx"),
        ("a<svg><title>no</title><style/><defs><text>no</text></defs>no<g><text>A<tspan>B</tspan></text></g></svg>c", "a\nAB\nc"),
        ("<p>a<svg><foreignObject><div>b</div></foreignObject></svg>c", "a\nb\nc"),
        ("<svg><g><p>out", "out"),
        ("so <math><mi> x </mi> <mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>.", "so x= 1 2 ."),
        # comments that end at once
        ("a<!-->b<!--->c<!-- x --!>d", "abcd"),
        # cells that span columns and rows, tables in cells, wide characters
        ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "wide cell here | z\na | b          | c"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>x<td>y</table>", "r | 1\n  | 2\nx | y"),
        ("<table><tr><td>x<table><tr><td>in<td>q</table><td>y</table>", "x      | y\nin | q |"),
        ("<table><tr><td>中文<td>b<tr><td>abcdef<td>c</table>", "中文   | b\nabcdef | c"),
        ("<table><tr><td colspan=999999999>a<tr><td rowspan=0>b<td>c<tr><td>d</table>", "a\nb | c\n  | d"),
        # what is folded away, list numbers, inputs
        ("<details>no<summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("<ol reversed><li>a<li>b<li value=7>c</ol>", "3. a\n2. b\n7. c"),
        ("<ol start=-2><li>a<li>b</ol>", "-2. a\n-1. b"),
        ("a <input value=v> <input type=hidden value=n> <input placeholder=ph> <input type=submit value=Go>", "a v ph Go"),
        # an implied end far up
        ("<table><tr>" + "<div>" * 20 + "<td>a<tr><td>b</table>", "a\nb"),
    ],
)
def test_html_all_visible_text(html, text):
    assert html_text.extract(html) == text


def test_html_against_a_page_that_knows_its_text():
    """Random pages are written together with the lines a reader should see."""
    rnd = random.Random(11)

    def block(depth):
        """(html, lines) of one block; list marks and table bars are left out of the lines."""
        word = lambda: "".join(rnd.choice("abcdé&<") for _ in range(rnd.randint(1, 5)))
        shown = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
        kind = rnd.choice(["p", "inline", "hidden", "ul", "table", "div", "pre"] if depth else ["p", "inline", "hidden"])
        if kind in ("p", "inline"):
            ws = [word() for _ in range(rnd.randint(1, 6))]
            marked = [rnd.choice(["{}", "<b>{}</b>", "<a href='x>y'>{}</a>", "<span><i>{}</i></span>", "{}<!-- c -->", "{}<script>if (a<b) '</p>'</script>"]).format(shown(w)) for w in ws]
            inside = rnd.choice([" ", "\n  "]).join(marked)
            return (f"<p>{inside}" + rnd.choice(["", "</p>"]) if kind == "p" else f"<div>{inside}</div>"), [" ".join(ws)]
        if kind == "hidden":
            return rnd.choice(["<div hidden>{}</div>", "<p style='display:none'>{}</p>", "<style>{}</style>", "<template>{}</template>", "<!-- {} -->"]).format("secret"), []
        parts = [block(depth - 1) for _ in range(rnd.randint(1, 3))]
        if kind == "ul":
            parts = [([word()], None) for _ in parts]
            end = rnd.choice(["", "</li>"])
            return "<ul>" + "".join(f"<li>{shown(w[0])}{end}" for w, _ in parts) + "</ul>", [w[0] for w, _ in parts]
        if kind == "table":
            cells = [[word() for _ in range(2)] for _ in parts]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{shown(w)}" for w in r) for r in cells) + "</table>", [" ".join(r) for r in cells]
        if kind == "pre":
            rows = [word() for _ in parts]
            return "<pre>" + "\n".join(map(shown, rows)) + "</pre>", rows
        return "<div>" + "".join(h for h, _ in parts) + "</div>", [x for _, ls in parts for x in ls]

    for _ in range(300):
        made = [block(3) for _ in range(rnd.randint(1, 5))]
        got = html_text.extract("<html><head><title>t</title></head><body>" + "".join(h for h, _ in made) + "</body></html>")
        lines = [re.sub(r"\s*\|\s*", " ", re.sub(r"^ *- ", "", x)).strip() for x in got.split("\n")]
        assert [x for x in lines if x] == [x for _, ls in made for x in ls]


def test_html_depth_and_nulls(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    df = spark.createDataFrame([(1, deep, "u"), (2, None, "u"), (None, "<p>a", "u"), (2, "<table>" * 50 + "q", "u")], "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in html_text.extract_pages(df).collect()), key=str)
    assert got == [(1, "x"), (2, ""), (2, "q"), (None, "a")]
    assert html_text.extract_pages(df.where("false")).count() == 0


def test_html_end_of_a_paragraph_that_is_not_open():
    assert html_text.extract("<p>a<div>b</p>c") == "a\n\nb\n\nc"
    assert html_text.extract("a</p>b") == "a\n\nb" and html_text.extract("<p>a</p>b") == "a\n\nb"
    assert html_text.extract("<p>a<p>b</p></p>c") == "a\n\nb\n\nc"


# ---- 8 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=4, loss_tokens=50, window=3)])
def test_packing(docs, texts, empty, limits):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts}
    rows = packing.pack(docs, path, limits=limits).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= min(limits.tokens, limits.loss_tokens) and len(own) <= limits.segments
        total += at
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    if limits.tokens == 4096:
        assert padding == 0
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_by_loss(spark, name):
    """Loss ranges decide which tokens count against the limit; tokenizers that keep white space read whole texts."""
    from tokenizers import Tokenizer

    path, rnd = tokenizer_path(name), random.Random(4)
    rows = []
    for i in range(150):
        prompt, answer = (" ".join(rnd.choice(["ask", "why", "überall", "it's 42", "☃ b"]) for _ in range(rnd.randint(0, 30))) for _ in range(2))
        text = f"{prompt}\n{answer}"
        rows.append((i, text, [(len(prompt) + 1, len(text))] if i % 7 else None))
    rows += [(500, None, [(0, 5)]), (501, "", []), (None, "a b", [(0, 1)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, mask array<struct<start:int,stop:int>>")
    limits = packing.Limits(tokens=64, segments=5, loss_tokens=20, window=16)
    got = packing.pack(df, path, limits=limits, loss="mask").collect()
    t, want = Tokenizer.from_file(path), {}
    for i, text, mask in rows:
        e = t.encode(text or "", add_special_tokens=False)
        at = [a for a, _ in e.offsets] + [len(text or "") - 1]
        want[i] = [any(a <= x < z for a, z in mask or ()) for x in at]
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert r.loss_tokens == sum(want[r.doc_id][r.start : r.start + r.length])
    assert {i: sum(r.length for r in p) for i, p in pieces.items()} == {i: len(m) for i, m in want.items()}
    for own in seqs.values():
        assert sum(r.length for r in own) <= 64 and len(own) <= 5 and sum(r.loss_tokens for r in own) <= 20


def test_dot_product_beats_largest_first():
    """Where loss is scarce, the dot product needs fewer sequences than taking the longest example."""

    def sequences(largest_first):
        rnd, packer = random.Random(3), packing._Packer(packing.Limits(tokens=256, segments=16, loss_tokens=64, window=32), 0)
        if largest_first:
            packer.per = [1.0, 0.0, 0.0]
        for i in range(600):
            n, share = rnd.randint(10, 120), rnd.choice([0.1, 0.2, 0.9, 0.0])
            k = int(n * (1 - share))
            packer.add(i, np.arange(n, dtype=np.uint32), np.concatenate([np.zeros(k + 1, int), np.arange(1, n - k + 1)]))
            packer.drain()
        packer.finish()
        return len({o[5] for o in packer.out})

    assert sequences(False) < 0.95 * sequences(True)


# ---- 9 ------------------------------------------------------------------------------------


def test_license_scan(spark, empty):
    mit, gpl = licenses.TEMPLATES["mit-notice"], licenses.TEMPLATES["gpl-3.0-notice"]
    filler = " ".join(f"w{i}" for i in range(200))
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"x {gpl.replace('either version 3', 'version three').upper()} y"), (3, "Released under the MIT License."), (4, None), (5, ""), (6, "four words only here"), (7, filler), (8, mit[: len(mit) // 2]), (None, "released UNDER\nthe mit license")]
    # templates of five to fifteen shingles that lack as many as they may, in the worst places
    short = {f"t{n}": " ".join(f"t{n}x{i}" for i in range(n + 4)) for n in range(1, 17)}
    for n in range(1, 17):
        words = short[f"t{n}"].split()
        for place in range(len(words)):
            rows.append((100 * n + place, "see " + " ".join([*words[:place], "other", *words[place + 1 :]]) + " there"))
        rows.append((100 * n + 50, " ".join([*words, "and", *words, "again"])))
    templates = licenses.TEMPLATES | short
    got = {(r.doc_id, r.template): r.containment for r in licenses.scan_licenses(docs_frame(spark, rows), templates).collect()}
    norm = lambda s: [w for w in re.split(r"[^\w]+|_", s.lower()) if w]
    grams = lambda s: {tuple(w[i : i + 5]) for w in [norm(s)] for i in range(len(w) - 4)}
    want = {}
    for i, t in rows:
        for name, notice in templates.items():
            c = len(grams(notice) & grams(t or "")) / len(grams(notice))
            if c >= 0.8:
                want[i, name] = pytest.approx(c)
    assert got == want and (2, "gpl-3.0-notice") in want and (None, "mit-short") in want
    twice = docs_frame(spark, [(1, mit), (1, mit), (None, mit), (2, "x " * 100_000 + mit)])
    # a name that the scan uses itself
    assert licenses.scan_licenses(twice.withColumns({"row": F.lit(1), "key": F.lit(2)}), {"h": mit}).count() == 4
    assert [(r.doc_id, r.n_found == r.n_shingles) for r in licenses.scan_licenses(twice).orderBy("doc_id").collect()] == [(None, True), (1, True), (1, True), (2, True)]
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(twice, {}).count() == 0


def test_license_bands_are_minhash_values(spark):
    known = {r.template: r for r in licenses.license_templates(spark).collect()}
    assert len(known) == len(licenses.TEMPLATES) == 23
    for r in known.values():
        assert not set(r["keys"]) & set(r["shingles"])  # no band is a shingle
        if len(r["shingles"]) >= licenses.LONG:
            assert len(r["keys"]) > licenses.BANDS  # several windows, all bands of each
    # the stated chance: windows with one shingle in eight replaced, and the bands of real windows
    assert licenses.chance(7 / 9) >= 0.999 and licenses.chance(0.6) >= 0.97 and licenses.chance(0.1) < 0.08
    rnd, pairs = random.Random(9), 4000

    def keys_of(rows):
        h = spark.createDataFrame([(i, side, h, 0) for i, side, h in rows], "id long, side int, h array<long>, at int")
        made = defaultdict(set)
        for r in licenses.banded(h, licenses.LONG_BANDS).collect():
            made[r.id, r.side].add(r.key)
        return made

    rows = []
    for i in range(pairs):
        w = [rnd.getrandbits(62) for _ in range(9)]
        rows += [(i, 0, w[:8]), (i, 1, w[1:])]
    made = keys_of(rows)
    assert all(len(k) == licenses.BANDS for k in made.values())
    assert sum(1 for i in range(pairs) if made[i, 0] & made[i, 1]) >= 0.997 * pairs
    made = keys_of([(i, s, [rnd.getrandbits(62) for _ in range(8)]) for i in range(300) for s in (0, 1)])
    assert not any(made[i, 0] & made[i, 1] for i in range(300))


def test_license_texts_with_a_fifth_of_the_shingles_gone(spark):
    rnd, rows, want = random.Random(13), [], set()
    templates = {f"t{n}": " ".join(f"t{n}x{i}" for i in range(n + 4)) for n in (20, 27, 40, 90)}
    norm = lambda s: s.split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for name, notice in templates.items():
        w, k = norm(notice), 0
        while k < 150:
            v = list(w)
            for _ in range(rnd.randint(1, max(1, len(w) // 20))):
                at = rnd.randrange(len(v))
                v[at : at + rnd.choice([0, 1, 1])] = ["edit"] * rnd.choice([0, 1, 1])
            if len(grams(v) & grams(w)) >= 0.8 * len(grams(w)):
                rows.append((len(rows), " ".join(["lead"] * rnd.randint(0, 7) + v + ["tail"] * 5)))
                want.add((len(rows) - 1, name))
                k += 1
    got = {(r.doc_id, r.template) for r in licenses.scan_licenses(docs_frame(spark, rows), templates).collect()}
    assert got == want


# ---- 10 -----------------------------------------------------------------------------------


def fingerprint_rows(rows):
    """What fingerprints() should say of (doc_id, text) rows in their order, from plain lists of leaves."""
    out = []
    for n, (doc, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        k = len(t) // 2
        new = t[: len(t) - k] + nxt[:k]

        def likeness(a, b):
            if a == b:
                return 1.0
            if not a and not b:
                return 1.0
            trees, common = [fingerprints.MerkleTree(a), fingerprints.MerkleTree(b)], 0
            left, right = ([(s[0], s[1], s[2]) for s in x.sections] for x in trees)
            for level in range(3):
                for x in list(left):
                    same = [y for y in right if y[0] == x[0]]
                    if same:
                        common += x[1]
                        left.remove(x)
                        right.remove(same[0])
                if level < 2:
                    left, right = ([y for x in side for y in x[2]] for side in (left, right))
            return 2 * common / (len(a) + len(b))

        out.append((doc, len(t), sha256(new.encode()).hexdigest(), fingerprints.MerkleTree(t).fingerprint, fingerprints.MerkleTree(new).fingerprint, round(likeness(t, new), 9), round(likeness(t, nxt), 9)))
    return out


def told(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()]


def test_fingerprints(spark, texts, docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BYTES", 3000)  # several parts, whose borders are crossed
    usual = [(i, t) for i, t in texts if len(t or "") < 10_000]
    assert sorted(told(fingerprints.fingerprints(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)))) == sorted(fingerprint_rows(usual))
    assert fingerprints.fingerprints(empty).count() == 0
    edge = [(-(2**63), "first"), (-(2**63) + 1, "x"), (2**53 + 1, "y"), (2**53 + 2, None), (2**63 - 2, "a b"), (2**63 - 1, "last")]
    assert sorted(told(fingerprints.fingerprints(docs_frame(spark, edge)))) == sorted(fingerprint_rows(edge))
    monkeypatch.setattr(fingerprints, "PART_BYTES", 300)
    monkeypatch.setattr(fingerprints, "PARTS_AT_ONCE", 2)
    rows = docs_frame(spark, [(7, f"text {i % 9}") for i in range(60)] + [(None, "n"), (None, "n"), (None, None), (9, "z")])
    order = [(r.doc_id, r.text) for r in rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.asc_nulls_first("doc_id"), "tie").collect()]
    assert sorted(told(fingerprints.fingerprints(rows)), key=str) == sorted(fingerprint_rows(order), key=str)
    lone = told(fingerprints.fingerprints(docs_frame(spark, [(3, "alone here")])))
    assert lone == fingerprint_rows([(3, "alone here")])


def test_merkle_tree_covers_the_text_and_locates_edits():
    text = "\n".join(" ".join(f"Line {i} word {j}." for j in range(5)) + ("\n" if i % 4 == 0 else "") for i in range(40))
    a = fingerprints.MerkleTree(text)
    assert sum(s[1] for s in a.sections) == len(text)
    at = len(text) // 2
    b = fingerprints.MerkleTree(text[:at] + "EDIT" + text[at + 4 :])
    gone = fingerprints.differences(b, a)
    assert gone and gone[0][0] <= at and gone[-1][1] >= at + 4 and gone[-1][1] - gone[0][0] < 60
    assert fingerprints.likeness(a, b) > 0.95 and fingerprints.likeness(a, a) == 1
    assert fingerprints.likeness(a, fingerprints.MerkleTree("nothing alike")) == 0


def test_leaves_are_cut_by_content(monkeypatch):
    rng = random.Random(5)
    words = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400))
    unspaced = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2000))
    for text in (words, unspaced, "-=" * 2000, "abcde fghij " * 200):
        a, at = fingerprints.MerkleTree(text), 300
        for changed in (text[:at] + "new " + text[at:], text[:at] + text[at + 5 :]):  # an insertion, a deletion
            b = fingerprints.MerkleTree(changed)
            gone = fingerprints.differences(b, a)
            assert a.root != b.root and fingerprints.likeness(a, b) > 0.9
            # the last piece of a repetition is as long as is left
            assert all(at - 150 <= lo and (hi <= at + 200 or text[:2] == "-=" and lo > len(changed) - 150) for lo, hi in gone)
        assert max(x[1] for s in a.sections for p in s[2] for x in p[2]) <= 160
    half = fingerprints.MerkleTree(fingerprints.edited(unspaced, words))
    assert fingerprints.likeness(fingerprints.MerkleTree(unspaced), half) > 0.45
    short = "one short sentence of less than four hundred characters without an end"
    assert fingerprints.likeness(fingerprints.MerkleTree(short), fingerprints.MerkleTree(fingerprints.edited(short, "Z" * 80))) > 0.2
    # a paragraph's pieces do not depend on its neighbours, nor on how much is read at once
    p = words[:300] + "\n"
    alone, inside = fingerprints.MerkleTree(p), fingerprints.MerkleTree("x\n\n" + p + unspaced)
    assert alone.sections[0][2][0] in [q for s in inside.sections for q in s[2]]
    whole = [fingerprints.MerkleTree(t).root for t in (words, unspaced, p * 3)]
    monkeypatch.setattr(fingerprints, "BLOCK", 37)
    assert [fingerprints.MerkleTree(t).root for t in (words, unspaced, p * 3)] == whole


# ---- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, keep_id int, component_id string, bucket int, __p int"
    rows = [(1, "a b c d e f", "en", None, 11, 9, 9, "x", 1, 1)] * 2 + [(2, "a  b c d e f", "en", None, 12, 9, 9, "x", 1, 1), (None, None, None, None, None, None, None, None, None, None), (3, "", None, None, 0, 1, 1, "", 0, 0)]
    odd = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() >= 0
        assert stage(spark, odd.where("false"), sf).count() == 0
    kept = corpus_pipeline.exact_stage(spark, odd, sf)
    assert kept.columns == corpus_pipeline.COLUMNS and sorted(r.doc_id or 0 for r in kept.collect()) == [2, 3]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "exact_dedup":
            best = {}
            for i, t in rows:
                k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
            assert ids == {i for _, i in best.values()}
        elif name == "near_dedup":
            assert ids == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
        else:
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
            assert len(ids & bad) <= 0.2 * len(bad) and len(ids) > len(rows) / 2
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
