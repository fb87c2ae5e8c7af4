"""Balanced assignment with jittered attempts: a sequential greedy rule, run in chunks that are checked against one another."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benthos.session import materialize

try:  # for short texts half the time of hashlib's, which is set up by OpenSSL for each of them
    from _sha2 import sha256
except ImportError:
    from hashlib import sha256

#: Groups that one task places in order.
CHUNK_GROUPS = 1_000_000

#: Places of groups in attempts that one task finds.
DEALT_PLACES = 2_000_000

#: Groups at a chunk's end from which it is guessed where the chunk will end.
TAIL_GROUPS = 20_000

#: Groups of a chunk that are placed one after another, while as many lanes of them are placed side by side; groups at a lane's end from which its end is guessed; lanes below which they go one by one; heads of a group up to which lanes are used; numbers that the lanes of a chunk hold.
LANE_GROUPS, LANE_TAIL, FEW_LANES, LANE_HEADS, LANE_NUMBERS = 1_000, 400, 24, 8, 8_000_000

#: Sizes of a head up to which what a part would cost is kept for each of them.
KEPT_SIZES = 4


def _sha(*x: object) -> str:
    return hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()


def _bytes(values: pa.Array) -> bytes:
    """An Arrow array as bytes, which Spark moves as they are."""
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([values], ["x"])
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _array(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all()["x"].combine_chunks()


class _Kinds:
    """The kinds of groups in a chunk: which heads (numbered) with how many rows each, padded with a head of no rows."""

    def __init__(self, profiles: list[str]):
        told = [json.loads(x) for x in profiles]
        self.of = [list(zip(x["h"], map(float, x["n"]))) for x in told]
        self.names = list(dict.fromkeys(h for x in told for h in x["h"]))
        number = {h: i for i, h in enumerate(self.names)}
        self.of = [[(number[h], n) for h, n in x] for x in self.of]
        self.most = max(map(len, self.of), default=0)
        self.heads = np.full((self.most, len(self.of)), len(self.names), np.int64)
        self.sizes = np.zeros((self.most, len(self.of)))
        for k, x in enumerate(self.of):
            for j, (h, n) in enumerate(x):
                self.heads[j, k], self.sizes[j, k] = h, n

    def shares(self, counts: np.ndarray, fractions: tuple[float, ...]) -> np.ndarray:
        """(..., part, head): about the targets' shares of so many (..., kind) groups, in whole groups.

        Sums of shares are sums of groups, so they keep what sums of groups have in common: where all
        groups have two rows, no part gets an odd number, which the rule could never make up for.
        """
        upto = np.concatenate([np.zeros((*counts.shape[:-1], 1)), np.cumsum(counts, -1)], -1)
        others = [np.diff(np.floor(upto * f + 0.5)) for f in fractions[1:]]
        out = np.zeros((*counts.shape[:-1], len(fractions), len(self.names) + 1))
        for p, own in enumerate([counts - sum(others), *others]):
            for j in range(self.most):
                for h in range(len(self.names)):
                    if (here := self.heads[j] == h).any():
                        out[..., p, h] += own[..., here] @ self.sizes[j, here]
        return out


def _in_order(place: np.ndarray, ids: pa.Array, attempt: int, seed: int) -> np.ndarray:
    """The order of the places; equal ones go by hash."""
    order = np.argsort(place, kind="stable")
    same = np.concatenate([[False], np.diff(place[order]) == 0, [False]])
    starts, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:]) + 1
    for a, b in zip(starts.tolist(), ends.tolist()):
        order[a:b] = sorted(order[a:b].tolist(), key=lambda i: _sha(seed, attempt, ids[i].as_py()))
    return order


class _Chunk:
    """Groups of one scope and attempt in order, and the rule over them."""

    def __init__(self, kinds: _Kinds, codes: np.ndarray, ids: pa.Array, attempt: int, seed: int, fractions: tuple[float, ...], totals: dict[str, float]):
        self.kinds, self.codes, self.ids, self.attempt, self.seed, self.fractions = kinds, codes, ids, attempt, seed, fractions
        self.goals = [[totals[h] * f for f in fractions] for h in kinds.names]
        self.units = [[max(g, 1.0) for g in goal] for goal in self.goals]

    def best(self, costs: list[float], i: int) -> int:
        """The part of the least cost for the i-th group, ties by hash."""
        least = min(costs)
        if costs.count(least) == 1:
            return costs.index(least)
        name = self.ids[i].as_py()
        return min([p for p in range(len(costs)) if costs[p] == least], key=lambda p: _sha(self.seed, self.attempt, name, p))

    def placed(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each group's part, and the rows per part and head at the end; ``start`` is where they begin.

        The chunk is cut into lanes, whose n-th groups are placed all at once, each lane from a guess of
        where it begins. Lanes that began from something else than where the lane before ended are placed
        again; the last few, or all where lanes do not settle, one after another. So all choices are
        those of the rule run in one go, whatever is guessed.
        """
        n, width = len(self.codes), len(self.kinds.names) + 1
        lanes = min(n // LANE_GROUPS, LANE_NUMBERS // (len(self.fractions) * max(width, len(self.kinds.of))))
        if lanes < FEW_LANES or self.kinds.most > LANE_HEADS:
            return self._one_by_one(0, n, start)
        length = -(-n // lanes)
        lanes = -(-n // length)
        pad = len(self.kinds.of)
        grid = np.full(lanes * length, pad, np.int64)
        grid[:n] = self.codes
        grid = grid.reshape(lanes, length)
        counts = np.bincount((np.arange(n) // length) * (pad + 1) + self.codes, minlength=lanes * (pad + 1)).reshape(lanes, pad + 1)[:, :pad]
        late = np.stack([np.bincount(x, minlength=pad + 1)[:pad] for x in grid[:, length - min(LANE_TAIL, length) :]])
        # where each lane's last groups begin, by shares of what lies before them, and from there where it ends
        guess = start + self.kinds.shares(np.cumsum(counts, 0) - late, self.fractions)
        _, ended = self._side_by_side(grid[:, length - min(LANE_TAIL, length) :], np.arange(lanes) * length + length - min(LANE_TAIL, length), guess)
        chosen, began, wrong, before = np.zeros((lanes, length), np.int8), np.full_like(ended, np.nan), np.arange(lanes), 2 * lanes
        while FEW_LANES <= len(wrong) <= before / 2:
            begin = np.concatenate([start[None], ended[:-1]])[wrong]
            chosen[wrong], ended[wrong] = self._side_by_side(grid[wrong], wrong * length, begin)
            began[wrong], before = begin, len(wrong)
            wrong = np.flatnonzero((began != np.concatenate([start[None], ended[:-1]])).any((1, 2)))
        for i in range(wrong[0] if len(wrong) else lanes, lanes):
            begin = ended[i - 1] if i else start
            if (began[i] != begin).any():
                a, b = i * length, min(n, (i + 1) * length)
                chosen[i, : b - a], ended[i] = self._one_by_one(a, b, begin)
        return chosen.reshape(-1)[:n], ended[-1]

    def _side_by_side(self, codes: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of (lane, n-th group), and where lanes end. ``first``: the numbers of lanes' first groups.

        Costs that are as good as equal are told apart as they are one by one, since a product and a power may
        be rounded differently.
        """
        lanes, length = codes.shape
        k, width = len(self.fractions), len(self.kinds.names) + 1
        heads = np.concatenate([self.kinds.heads, np.full((self.kinds.most, 1), width - 1)], 1)
        sizes = np.concatenate([self.kinds.sizes, np.zeros((self.kinds.most, 1))], 1)
        goals, units = np.zeros((k, width)), np.ones((k, width))
        goals[:, :-1], units[:, :-1] = np.array(self.goals).T, np.array(self.units).T
        reach = ((np.abs(goals) + start.max(0) + sizes.max(initial=0) * length) ** 2 / units).max(0)
        near = 1e-15 * reach[heads].sum(0)
        near[-1] = -1.0  # padding is never told apart
        goal_of, unit_of = [np.ascontiguousarray(goals[:, h]) for h in heads], [np.ascontiguousarray(units[:, h]) for h in heads]
        have = np.ascontiguousarray(start.transpose(1, 0, 2)).reshape(k, lanes * width)
        flat, base, chosen = have.reshape(-1), np.arange(lanes) * width, np.empty((length, lanes), np.int8)
        codes = np.ascontiguousarray(codes.T)
        for s in range(length):
            code = codes[s]
            at = [base + h.take(code) for h in heads]
            rows = [n.take(code) for n in sizes]
            cost = None
            for j in range(self.kinds.most):
                now = have.take(at[j], axis=1)
                now -= goal_of[j].take(code, axis=1)
                more = have.take(at[j], axis=1)
                more += rows[j]
                more -= goal_of[j].take(code, axis=1)
                more *= more
                now *= now
                more -= now
                more /= unit_of[j].take(code, axis=1)
                cost = more if cost is None else cost + more
            best = cost.argmin(0)
            close = (cost <= cost.min(0) + near.take(code)).sum(0) > 1
            for i in np.flatnonzero(close).tolist():
                told = self._costs(int(code[i]), have[:, i * width : (i + 1) * width])
                best[i] = self.best(told, int(first[i]) + s)
            chosen[s] = best
            best *= lanes * width
            for j in range(self.kinds.most):
                flat[best + at[j]] += rows[j]
        return chosen.T, have.reshape(k, lanes, width).transpose(1, 0, 2).copy()

    def _costs(self, code: int, have: np.ndarray) -> list[float]:
        costs = [0.0] * len(self.fractions)
        for h, n in self.kinds.of[code]:
            costs = [c + ((old + n - goal) ** 2 - (old - goal) ** 2) / unit for c, old, goal, unit in zip(costs, have[:, h].tolist(), self.goals[h], self.units[h])]
        return costs

    def _one_by_one(self, a: int, b: int, start: np.ndarray) -> tuple[list[int], np.ndarray]:
        of, goals, units, chosen, at = self.kinds.of, self.goals, self.units, [], a
        have = start.T.tolist()
        sizes = [[] for _ in have]  # of each head: (number of a head and size, size)
        for h, n in dict.fromkeys(x for kind in of for x in kind):
            sizes[h].append(n)
        kept = max(map(len, sizes), default=0) <= KEPT_SIZES

        def costs_of(h: int, n: float) -> list[float]:
            return [((old + n - goal) ** 2 - (old - goal) ** 2) / unit for old, goal, unit in zip(have[h], goals[h], units[h])]

        cost = {(h, n): costs_of(h, n) for h, own in enumerate(sizes) for n in own} if kept else {}
        for code in self.codes[a:b].tolist():
            heads = of[code]
            costs = [0.0] * len(self.fractions) if len(heads) != 1 else cost[heads[0]] if kept else costs_of(*heads[0])
            if len(heads) != 1:
                for x in heads:
                    costs = [c + d for c, d in zip(costs, cost[x] if kept else costs_of(*x))]
            best = self.best(costs, at)
            for h, n in heads:
                have[h][best] = now = have[h][best] + n
                if kept:
                    goal, unit = goals[h][best], units[h][best]
                    for m in sizes[h]:
                        cost[h, m][best] = ((now + m - goal) ** 2 - (now - goal) ** 2) / unit
            chosen.append(best)
            at += 1
        return chosen, np.array(have).T


def _cuts(per: DataFrame, scope: str, limit: int) -> dict:
    """Of each scope of more than ``limit`` groups: places that cut its order into chunks of fewer, about equal ones.

    Places are spread alike in all attempts, so they are taken from any hash. At most as many numbers
    as there are such chunks; the number of chunks is a power of two, so queries are few.
    """
    sizes = per.groupBy(scope).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / limit))).cast("int")
    sizes = materialize(sizes.select(scope, parts.alias("parts")), "attempt-scopes")
    place = -F.col("size") * (0.9 + 0.2 * F.pmod(F.xxhash64("group_id"), F.lit(1 << 40)) / float(1 << 40))
    out = {}
    for r in sizes.select("parts").distinct().collect():
        own = null_safe_semi(per, sizes.where(F.col("parts") == r["parts"]), [scope])
        at = F.percentile_approx(place, [i / r["parts"] for i in range(1, r["parts"])], max(10_000, 20 * r["parts"]))
        out |= {x[scope]: np.unique(x["at"]) for x in own.groupBy(scope).agg(at.alias("at")).collect()}
    return out


def null_safe_semi(a: DataFrame, b: DataFrame, keys: list[str], kind: str = "left_semi") -> DataFrame:
    """The rows of a whose keys are found in b (or, by left_anti, are not); null equals null."""
    b = b.select(*[F.col(c).alias(f"__{c}") for c in keys])
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], kind)


def jittered_assignment(groups: DataFrame, fractions: tuple[float, ...], seed: int, scope: str = "route", names: tuple[str, ...] = ("train", "valid", "test"), attempts: int = 16, chunk_groups: int | None = None) -> DataFrame:
    """(scope, group_id, split_part, attempt): the best of several greedy placements with shuffled sizes.

    ``groups`` has one row per (scope, group_id, head) with n. In each attempt the groups of a
    scope are placed in falling order of size * (0.9 + 0.2 u), u a hash of seed, attempt and
    group, each into the part whose squared deviation from the heads' targets grows least (ties
    by hash). The attempt with the least final deviation over all scopes wins, the first of
    equals; it is returned with the parts.

    The rule is sequential, but what a group needs to know is only how many rows its heads have
    in each part so far. So each attempt's order is cut into chunks of groups, and all chunks
    are placed at once, each from a guess of where it starts: where the last groups of the chunk
    before end, if these begin from the targets' shares of what lies before them. Where a head stood
    at the end of one chunk is where it begins in the next that has it; chunks that began from
    something else are placed again, until none did. Then all choices are those of the rule run in
    one go. The first chunk that is wrong gets its true start, so each round settles one more of each
    attempt at least. Guesses are made of whole groups, so the rule forgets them soon where any sizes
    allow it; else chunks settle one after another, and the rounds look less far ahead, so that little
    is placed in vain. Within a chunk, lanes of groups are placed side by side in the same way (see
    ``_Chunk.placed``).

    Groups are hashed and dealt to chunks in blocks of bytes, and a chunk is one row: the number of
    each group's kind (its rows per head) in one to four bytes, and the groups' ids. So neither
    attempts nor rounds move groups as rows. Tasks hold a chunk and the counts of its heads, or the
    groups of which they find the places.
    """
    kind, k = dict(groups.dtypes), len(fractions)
    fractions = tuple(map(float, fractions))
    limit = chunk_groups or CHUNK_GROUPS
    g = groups.select(F.col(scope), F.col("group_id"), F.col("head").cast("string").alias("head"), F.col("n").cast("double").alias("n"))
    per = g.groupBy(scope, "group_id").agg(F.array_sort(F.collect_list(F.struct("head", "n"))).alias("hn"), F.sum("n").alias("size"))
    profile = F.to_json(F.struct(F.transform("hn", lambda x: x["head"]).alias("h"), F.transform("hn", lambda x: x["n"]).alias("n")))
    per = materialize(per.select(scope, "group_id", F.col("group_id").cast("string").alias("text"), "size", profile.alias("profile")), "attempt-groups")
    total = per.count()
    cuts = _cuts(per, scope, limit)
    block = f"{scope} {kind[scope]}, attempt int, chunk int, places binary, codes binary, ids binary, profiles array<string>"
    columns = f"{scope} {kind[scope]}, attempt int, chunk int, names array<string>, masses array<double>, shares array<array<double>>, profiles array<string>, codes binary, ids binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all groups in a task: their places in each attempt, a row for each scope, attempt and chunk."""
        if not (batches := list(batches)):
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        scopes = rows[scope].combine_chunks().dictionary_encode("encode")
        number = scopes.indices.to_numpy()
        by_scope = np.argsort(number, kind="stable")
        for mine in np.split(by_scope, np.flatnonzero(np.diff(number[by_scope])) + 1):
            own, value = rows.take(mine), scopes.dictionary[int(number[mine[0]])]
            texts = [b"" if x is None else b"|" + x.encode() for x in own["text"].to_pylist()]
            size, ids = own["size"].to_numpy(), own["group_id"].combine_chunks()
            told = own["profile"].combine_chunks().dictionary_encode()
            code, at = told.indices.to_numpy(), cuts.get(value.as_py(), np.empty(0))
            for attempt in range(attempts):
                begin = f"{seed}|{attempt}".encode()
                hashes = np.frombuffer(b"".join([sha256(begin + x).digest() for x in texts]), ">u8")[::4]
                place = -size * (0.9 + 0.2 * (hashes.astype(np.float64) / 2.0**64))
                chunk = np.searchsorted(at, place)
                order = np.argsort(chunk, kind="stable")
                for there in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                    kinds, here = np.unique(code[there], return_inverse=True)
                    arrays = [pa.array([x], t) for x, t in ((attempt, pa.int32()), (chunk[there[0]], pa.int32()), (place[there].tobytes(), pa.binary()), (here.astype(np.int32).tobytes(), pa.binary()), (_bytes(ids.take(there)), pa.binary()), (told.dictionary.take(kinds).to_pylist(), pa.list_(pa.string())))]
                    yield pa.RecordBatch.from_arrays([pa.array([value.as_py()], rows.schema.field(scope).type), *arrays], [scope, "attempt", "chunk", "places", "codes", "ids", "profiles"])

    def pack(rows: pa.Table) -> pa.Table:
        """The blocks of a chunk as one, its groups in order."""
        number, codes = {}, []
        for data, profiles in zip(rows["codes"].to_pylist(), rows["profiles"].to_pylist()):
            codes.append(np.array([number.setdefault(x, len(number)) for x in profiles])[np.frombuffer(data, np.int32)])
        codes, ids = np.concatenate(codes), pa.concat_arrays([_array(x) for x in rows["ids"].to_pylist()])
        place = np.concatenate([np.frombuffer(x) for x in rows["places"].to_pylist()])
        order = _in_order(place, ids, rows["attempt"][0].as_py(), seed)
        kinds, counts = _Kinds(list(number)), np.bincount(codes, minlength=len(number))
        shares = kinds.shares(counts, fractions)[:, :-1].T
        masses = np.zeros(len(kinds.names) + 1)
        for h, n in zip(kinds.heads, kinds.sizes):
            np.add.at(masses, h, n * counts)
        narrow = np.uint8 if len(number) <= 256 else np.int32
        told = {"names": (kinds.names, pa.list_(pa.string())), "masses": (masses[:-1].tolist(), pa.list_(pa.float64())), "shares": (shares.tolist(), pa.list_(pa.list_(pa.float64()))), "profiles": (list(number), pa.list_(pa.string())), "codes": (codes[order].astype(narrow).tobytes(), pa.binary()), "ids": (_bytes(ids.take(order)), pa.binary())}
        out = rows.select([scope, "attempt", "chunk"]).slice(0, 1)
        for name, (x, t) in told.items():
            out = out.append_column(name, pa.array([x], t))
        return out

    spread = per.repartition(max(1, math.ceil(total * attempts / DEALT_PLACES)), "group_id")
    dealt = materialize(spread.mapInArrow(deal, block).groupBy(scope, "attempt", "chunk").applyInArrow(pack, columns), "attempt-chunks")

    chunk = [scope, "attempt", "chunk"]
    mass = dealt.select(*chunk, F.explode(F.arrays_zip("names", "masses", "shares")).alias("x")).select(*chunk, F.col("x.names").alias("head"), F.col("x.masses").alias("mass"), F.col("x.shares").alias("share"))
    mass = materialize(mass, "attempt-masses")  # a row per chunk and head of it
    so_far = Window.partitionBy(scope, "attempt", "head").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(scope, "attempt", "head")
    # of each chunk and head: where the chunk began when it was placed last, and where it ended (at first a guess)
    guess = F.array(*[F.coalesce(F.sum(F.col("share")[p]).over(so_far), F.lit(0.0)) for p in range(k)])
    state = mass.select(*chunk, "head", F.sum("mass").over(whole).alias("total"), guess.alias("start"), "share")

    of_chunk = f"{scope} {kind[scope]}, attempt int, chunk int"

    def told(row: dict, last: int | None = None) -> tuple[_Chunk, np.ndarray]:
        """A chunk with its start, or its last groups with about theirs."""
        own, kinds = {x["head"]: x for x in row["own"]}, _Kinds(row["profiles"])
        codes = np.frombuffer(row["codes"], np.uint8 if len(row["profiles"]) <= 256 else np.int32)
        ids, start = _array(row["ids"]), np.zeros((k, len(kinds.names) + 1))
        start[:, :-1] = np.array([own[h]["start"] for h in kinds.names]).T
        if last and last < len(codes):
            start = start + kinds.shares(np.bincount(codes[:-last], minlength=len(kinds.of)), fractions)
            codes, ids = codes[-last:], ids[-last:]
        return _Chunk(kinds, codes, ids, row["attempt"], seed, fractions, {h: x["total"] for h, x in own.items()}), start

    def ends(last: int | None):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    rows, start = told(row, last)
                    ended = dict(zip(rows.kinds.names, rows.placed(start)[1].T.tolist()))
                    own = [{scope: row[scope], "attempt": row["attempt"], "chunk": row["chunk"], "head": x["head"], "total": x["total"], "began": None if last else x["start"], "ended": ended[x["head"]]} for x in row["own"]]
                    floats = pa.list_(pa.float64())
                    yield pa.RecordBatch.from_pylist(own, pa.schema([batch.schema.field(scope), ("attempt", pa.int32()), ("chunk", pa.int32()), ("head", pa.string()), ("total", pa.float64()), ("began", floats), ("ended", floats)]))

        return of

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rows, start = told(row)
                chosen = np.asarray(rows.placed(start)[0])
                size = len(chosen)
                parts = pa.DictionaryArray.from_arrays(pa.array(chosen, pa.int32()), pa.array(names)).cast(pa.string())
                same = batch.select([scope, "attempt"]).take(pa.array(np.full(size, i)))
                yield pa.RecordBatch.from_arrays([same[scope], rows.ids, parts, same["attempt"]], [scope, "group_id", "split_part", "attempt"])

    def met(rows: DataFrame, own: DataFrame) -> DataFrame:
        """The chunks of which there are rows of (head, total, start), with these in one array; they are written, so that where they are few they go to the chunks, not chunks to them."""
        own = materialize(own.groupBy(*chunk).agg(F.collect_list(F.struct("head", "total", "start")).alias("own")), "attempt-asked")
        own = own.withColumnsRenamed({c: f"__{c}" for c in chunk})
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in chunk]
        return rows.join(own, on).select(*chunk, "profiles", "codes", "ids", "own")

    ended = f"{of_chunk}, head string, total double, began array<double>, ended array<double>"
    if cuts:  # where chunks end, as far as their last groups tell
        state = materialize(met(dealt, state).mapInArrow(ends(TAIL_GROUPS), ended), "attempt-state")
    else:
        state = materialize(state.select(*chunk, "head", "total", F.lit(None).cast("array<double>").alias("began"), F.col("start").alias("ended")), "attempt-state")

    true = F.coalesce(F.last("ended").over(so_far), F.array_repeat(F.lit(0.0), k))
    parts = max((len(x) + 1 for x in cuts.values()), default=1)
    ahead, waiting = parts, None
    while True:
        starts = materialize(state.withColumn("start", true), "attempt-starts")
        wrong = starts.where("began is null or began <> start").select(*chunk).distinct()
        first = F.row_number().over(Window.partitionBy(scope, "attempt").orderBy("chunk"))
        wrong = materialize(wrong.withColumn("nth", first), "attempt-wrong")
        left = wrong.count()
        if not left:
            break
        if waiting is not None:  # look further ahead while chunks settle, less far while they do not
            ahead = min(parts, 2 * ahead) if waiting - left >= asked / 2 else max(1, ahead // 2)
        todo = wrong.where(F.col("nth") <= ahead).select(*chunk)
        waiting, asked = left, todo.count()
        again = met(dealt, null_safe_semi(starts, todo, chunk)).mapInArrow(ends(None), ended)
        state = materialize(null_safe_semi(state, todo, chunk, "left_anti").unionByName(again), "attempt-state")
    last = starts.groupBy(scope, "attempt", "head").agg(F.first("total").alias("total"), F.max_by("ended", "chunk").alias("ended"))
    cost = F.lit(0.0)
    for p, f in enumerate(fractions):
        goal = F.col("total") * f
        cost = cost + (F.col("ended")[p] - goal) ** 2 / F.greatest(goal, F.lit(1.0))
    ranked = last.groupBy("attempt").agg(F.round(F.sum(cost), 9).alias("cost")).orderBy("cost", "attempt")
    best = ranked.first()
    if best is None:
        return per.select(scope, "group_id", F.lit(None).cast("string").alias("split_part"), F.lit(None).cast("int").alias("attempt")).limit(0)
    mine = F.col("attempt") == best["attempt"]
    return met(dealt.where(mine), starts.where(mine)).mapInArrow(choices, f"{scope} {kind[scope]}, group_id {kind['group_id']}, split_part string, attempt int")
