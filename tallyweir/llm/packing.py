"""Filling containers of fixed capacity with texts of varying length.

A configuration linear program over the length histogram says how many
containers to fill in which way. Its first columns come from an exact filling:
from the longest length down, a subset-sum program fills the room beside it with
the longest lengths that fit exactly. Then multiplicative weights take over: the
weight of a length falls exponentially with the share of its demand that is
covered, and a knapsack dynamic program over all lengths prices the best
configuration at those weights, for every length at once. Weights divided by the
best price are dual feasible, so every round also proves a bound that no packing
can beat; the rounds end early once the first columns are proven to be within a
container of it.

Rounding keeps the whole multiples of configurations that are full but for
``capacity / 1024`` tokens and fills exactly what they leave. Of that, the first
columns alone and best fit, the fewest containers win. All of it works on at most
``capacity`` lengths and in a number of steps that depends on the lengths only, so
its cost does not depend on the corpus. Texts then find their container by the
rank they have among the texts of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweir.llm.tokenizer import VOCABULARY, token_counts
from tallyweir.session import written

CAPACITY = 2048
#: Rounds of the weights, greatest share of a demand covered in one, and their rate.
ROUNDS, STEP, ETA = 120, 1 / 48, 48.0
#: Near ties of a price are broken at random within this share, so that configurations differ.
NEAR = 2e-3
#: Parts in which the texts of one length are ranked; a length may hold a third of all texts.
PARTS = 128


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over ``lengths`` (ascending): of each room the best worth, and the
    length that is put in last (-1: none fits)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = fits[room]
        if k:
            offer = best[room - lengths[:k]] + worth[:k]
            i = int((offer + noise[room : room + k]).argmax())
            best[room], last[room] = offer[i], i
            if best[room - 1] > best[room]:
                best[room], last[room] = best[room - 1], -2  # leave a token free
    return best, last


def family(lengths: np.ndarray, last: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, length index) pairs: pattern i is length i and the best filling of
    the room it leaves. An index stands once for each time it is put in."""
    who, what = [np.arange(len(lengths))], [np.arange(len(lengths))]
    at, room = np.arange(len(lengths)), capacity - lengths
    while len(at):
        i = last[room]
        free = i == -2
        room = np.where(free, room - 1, room)
        put = i >= 0
        who.append(at[put])
        what.append(i[put])
        room = np.where(put, room - lengths[np.maximum(i, 0)], room)
        keep = put | free
        at, room = at[keep], room[keep]
    return np.concatenate(who), np.concatenate(what)


@dataclass(frozen=True)
class Program:
    """``configs`` cover the histogram, {length: how many} with fractional multiples;
    ``trial`` are the ones the weights took, as often as a length in the middle of
    the histogram needs them; no packing has fewer containers than ``bound``."""

    configs: list[tuple[dict[int, int], float]]
    trial: list[tuple[dict[int, int], float]]
    bound: float


def program(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = STEP, eta: float = ETA) -> Program:
    first = _Plan(histogram, capacity)
    first.fill_exactly()
    seeds = [(c, float(n)) for c, n in first.filled]
    if not seeds:
        return Program([], [], 0.0)
    lengths = np.array(sorted(first.rank), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    m, rng = len(lengths), np.random.default_rng(1)
    covered, bound = np.zeros(m), 0.0
    multiples: dict[bytes, float] = {}
    shapes: dict[bytes, np.ndarray] = {}
    for turn in range(rounds):
        worth = lengths / capacity * np.exp(-eta * (covered - covered.min()))
        worth /= worth.max()
        if turn % 8 == 0:  # the bound needs the best price itself, not a near tie
            exact, _ = price(lengths, worth, capacity, np.zeros(capacity + 1 + m))
            bound = max(bound, float(demand @ worth) / exact[capacity])
            if first.used < bound * (1 - 1e-9) + 1:
                break
        _, last = price(lengths, worth, capacity, rng.random(capacity + 1 + m) * NEAR * worth.mean())
        who, what = family(lengths, last, capacity)
        order = np.lexsort((what, who))
        who, what = who[order], what[order]
        cut = np.searchsorted(who, np.arange(m + 1))
        value = np.bincount(who, worth[what], m)
        good = value >= 0.98 * value.max()
        # Each pattern by the demand its own length lags behind with, but no length gains more than a step.
        wish = demand * good * np.exp(-eta * (covered - covered.min()))
        allowed = np.minimum(1, demand / np.maximum(np.bincount(what, wish[who], m), 1e-300))
        x = step * wish * np.minimum.reduceat(allowed[what], cut[:-1])
        covered += np.bincount(what, x[who], m) / demand
        for i in np.flatnonzero(good).tolist():
            shape = what[cut[i] : cut[i + 1]]
            key = shape.tobytes()
            multiples[key] = multiples.get(key, 0.0) + float(x[i])
            shapes.setdefault(key, shape)
    found = []
    for key, n in multiples.items():
        items, counts = np.unique(shapes[key], return_counts=True)
        found.append((dict(zip(lengths[items].tolist(), counts.tolist(), strict=True)), n))
    least, middle = float(covered.min()), float(np.median(covered))
    taken = sum(n for _, n in found)
    covering = [(c, n / least) for c, n in found] if least > 0 and taken < first.used * least else seeds
    return Program(covering, [(c, n / middle) for c, n in found] if middle > 0 else seeds, bound)


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional multiples that cover the histogram."""
    return program(histogram, capacity).configs


class _Plan:
    """A packing in the making: what is left of each length, and rows as ``plan`` gives them."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.rest = {x: n for x, n in histogram.items() if 0 < x <= capacity and n > 0}
        self.rank = dict.fromkeys(self.rest, 0)
        self.capacity, self.rows, self.used = capacity, [], 0
        self.filled: list[tuple[dict[int, int], int]] = []

    def put(self, length: int, first: int, containers: int, each: int) -> None:
        self.rows.append((length, self.rank[length], self.rank[length] + containers * each - 1, first, each))
        self.rank[length] += containers * each
        self.rest[length] -= containers * each

    def fill(self, config: dict[int, int], most: int) -> int:
        n = min(most, *[self.rest[x] // k for x, k in config.items()])
        if n > 0:
            for x, k in config.items():
                self.put(x, self.used, n, k)
            self.used += n
            self.filled.append((config, n))
        return max(n, 0)

    def keep_full(self, configs: list[tuple[dict[int, int], float]]) -> None:
        """Whole multiples of the full configurations, most used first. No more of
        them than four a length: what others would hold is left to ``fill_exactly``."""
        left = 4 * max(len(self.rest), 1)
        for config, x in sorted(configs, key=lambda c: -c[1]):
            if left and x >= 1 and self.capacity - sum(k * n for k, n in config.items()) <= self.capacity // 1024:
                left -= self.fill(config, int(x)) > 0

    def fill_exactly(self) -> None:
        """From the longest length down: the longest lengths that together fill the
        room beside it best, in as many containers as there are."""
        for length in sorted(self.rest, reverse=True):
            while self.rest[length]:
                config, room = {length: 1}, self.capacity - length
                small = [x for x in sorted(self.rest) if x <= min(room, length) and self.rest[x] - (x == length) > 0]
                reach, stages = 1, [1]
                mask = (1 << (room + 1)) - 1
                for x in small:
                    copies, k = min(self.rest[x] - (x == length), room // x), 1
                    while copies > 0:
                        k = min(k, copies)
                        reach |= reach << (k * x)
                        copies -= k
                        k *= 2
                    reach &= mask
                    stages.append(reach)
                at = reach.bit_length() - 1  # the fullest room
                for i in range(len(small) - 1, -1, -1):
                    x, copies = small[i], self.rest[small[i]] - (small[i] == length)
                    while at >= x and copies and stages[i + 1] >> (at - x) & 1 and (k := self._enough(stages[i], at, x, copies)):
                        config[x] = config.get(x, 0) + k
                        at, copies = at - k * x, 0
                self.fill(config, self.rest[length])

    @staticmethod
    def _enough(below: int, at: int, x: int, copies: int) -> int:
        """The most copies of ``x`` beside which shorter lengths fill the rest of ``at``; 0 if none."""
        for k in range(min(copies, at // x), 0, -1):
            if below >> (at - k * x) & 1:
                return k
        return 0

    def best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}
        spaces: list[int] = []

        def leave(space: int, first: int, containers: int) -> None:
            if space and containers:
                if space not in open_:
                    insort(spaces, space)
                open_.setdefault(space, []).append((first, containers))

        for length in sorted(self.rest, reverse=True):
            while self.rest[length]:
                i = bisect_left(spaces, length)
                if i == len(spaces):
                    space, first, n = self.capacity, self.used, -(-self.rest[length] // (self.capacity // length))
                    self.used += n
                else:
                    space = spaces[i]
                    first, n = open_[space].pop()
                    if not open_[space]:
                        del open_[space], spaces[i]
                each = space // length
                full = min(n, self.rest[length] // each)
                if full:
                    self.put(length, first, full, each)
                    leave(space - each * length, first, full)
                if full < n:
                    left = min(self.rest[length], each)
                    if left:
                        self.put(length, first + full, 1, left)
                    leave(space - left * length, first + full, 1)
                    leave(space, first + full + 1, n - full - 1)


@dataclass(frozen=True)
class Packing:
    """``rows`` (length, first rank, last rank, first container, how many in each),
    the containers used, the bound none can beat and how the rows came about."""

    rows: list[tuple[int, int, int, int, int]]
    containers: int
    bound: int
    how: str


def packed(histogram: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """The packing of a histogram {length: how many}."""
    sound = {x: n for x, n in histogram.items() if 0 < x <= capacity and n > 0}
    found = program(sound, capacity)
    weighted, first, best = (_Plan(sound, capacity) for _ in range(3))
    weighted.keep_full(found.trial)
    weighted.fill_exactly()
    first.fill_exactly()
    best.best_fit()
    used, _, how, rows = min((p.used, i, how, p.rows) for i, (p, how) in enumerate(((first, "first columns"), (weighted, "weights"), (best, "best fit"))))
    total = sum(x * n for x, n in sound.items())
    return Packing(rows, used, max(-(-total // capacity), int(np.ceil(found.bound * (1 - 1e-9)))), how)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first container, how many in each): where
    the texts of each length go, by their rank from 0. Containers count from 0."""
    return packed(histogram, capacity).rows


#: Into how many stretches of ranks the texts of one length are told apart before they look for their row of the plan.
STRETCHES = 16


def _pieces(documents: DataFrame, doc_id: str, text: str, capacity: int, path: str) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens``; texts of no tokens are one empty piece."""
    counts = written(token_counts(documents, doc_id, text, path), "token-counts")
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(n_tokens - 1) div {capacity}"))))
    return counts.select("doc_id", "n_tokens", piece.alias("piece")).select(
        "doc_id", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * capacity).cast("bigint").alias("first_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"),
    )


def _histogram(sizes: DataFrame) -> dict[int, int]:
    return {r["n_tokens"]: r["n"] for r in sizes.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity entries


def containers(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """``container_id, doc_id, piece, first_token, n_tokens``: one row per text, or
    per piece of a text of more than ``capacity`` tokens.

    Such a text is cut into full containers and a rest, which is placed like a
    text. Texts without tokens (null and empty ones) take no room and have a NULL
    container. Rows that repeat an id are placed each for itself.
    """
    spark = documents.sparkSession
    pieces = _pieces(documents, doc_id, text, capacity, path)
    parted = pieces.where("n_tokens > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int"))
    sizes = parted.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))  # at most capacity x PARTS rows
    histogram = _histogram(sizes)
    width = {x: -(-n // STRETCHES) for x, n in histogram.items()}
    # A row of the plan stands in every stretch of ranks it reaches into: at most STRETCHES more a length.
    table = [(x, at, low, high, first, each) for x, low, high, first, each in plan(histogram, capacity) for at in range(low // width[x], high // width[x] + 1)]
    where = spark.createDataFrame(table, "n_tokens bigint, stretch bigint, low bigint, high bigint, first bigint, each bigint")
    length = W.partitionBy("n_tokens")
    ahead = sizes.select(
        "n_tokens", "part", (F.sum("n").over(length.orderBy("part")) - F.col("n")).alias("ahead"),
        F.ceil(F.sum("n").over(length) / STRETCHES).alias("width"),
    )
    ranked = (
        parted.withColumn("rank", F.row_number().over(W.partitionBy("n_tokens", "part").orderBy("doc_id", "piece")) - 1)
        .join(ahead, ["n_tokens", "part"])  # the rank has this partitioning already
        .withColumn("rank", F.col("rank") + F.col("ahead"))
        .withColumn("stretch", F.expr("rank div width"))
    )
    at = ranked.alias("r").join(F.broadcast(where).alias("p"), ["n_tokens", "stretch"]).where(F.col("rank").between(F.col("low"), F.col("high")))
    placed = at.select(F.expr("first + (rank - low) div each").alias("container_id"), "doc_id", "piece", "first_token", "n_tokens")
    none = pieces.where("n_tokens = 0").select(F.lit(None).cast("bigint").alias("container_id"), "doc_id", "piece", "first_token", "n_tokens")
    return placed.unionByName(none)


def packing_quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """``pieces, tokens, containers, bound, gap, how``, one row: the containers that
    ``containers`` fills, the bound no packing can beat, by how much it is missed
    and which rounding won."""
    sizes = _pieces(documents, doc_id, text, capacity, path).where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    histogram = _histogram(sizes)
    got = packed(histogram, capacity)
    row = (sum(histogram.values()), sum(x * n for x, n in histogram.items()), got.containers, got.bound, got.containers / max(got.bound, 1) - 1 if got.bound else 0.0, got.how)
    return documents.sparkSession.createDataFrame([row], "pieces bigint, tokens bigint, containers bigint, bound bigint, gap double, how string")
