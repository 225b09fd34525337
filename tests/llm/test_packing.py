import random
from collections import Counter

import numpy as np
import pytest

from tallyweir.llm import packing as P


def check(histogram, capacity, rows):
    placed, room = Counter(), Counter()
    for length, low, high, first, each in rows:
        for rank in range(low, high + 1):
            placed[length, rank] += 1
            room[first + (rank - low) // each] += length
    assert placed == Counter({(x, r): 1 for x, n in histogram.items() for r in range(n)})
    assert max(room.values(), default=0) <= capacity
    assert sorted(room) == list(range(len(room)))
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_everything_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 200])
    histogram = {rng.randrange(1, capacity + 1): rng.choice([1, 2, 9, 120]) for _ in range(rng.randrange(1, 30))}
    used = check(histogram, capacity, P.plan(histogram, capacity))
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    assert used <= 1.25 * least + sum(n for x, n in histogram.items() if 2 * x > capacity) + 1


def test_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.5, 0.9, 20_000).astype(int), 1, 2048), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    used = check(histogram, 2048, P.plan(histogram))
    assert used <= 1.002 * -(-int((lengths * counts).sum()) // 2048)


def test_fractional_solution_covers_all_lengths():
    histogram = {700: 40, 348: 80, 1000: 33, 24: 50, 2048: 7}
    covered = Counter()
    for config, x in P.solve(histogram, 2048):
        assert sum(k * m for k, m in config.items()) <= 2048
        for k, m in config.items():
            covered[k] += x * m
    assert all(covered[k] >= n - 1e-6 for k, n in histogram.items())


def test_price_finds_the_best_configuration():
    lengths, worth = np.array([3, 5, 6]), np.array([3.1, 5.5, 6.0])
    best, last = P.price(lengths, worth, 11, np.zeros(16))
    assert best[11] == pytest.approx(11.7)  # 5 + 3 + 3 against 11.5 of 6 + 5
    who, what = P.family(lengths, last, 11)
    assert sorted(what[who == 1].tolist()) == [0, 0, 1] and sorted(what[who == 2].tolist()) == [1, 2]
    assert P.plan({}) == [] and P.plan({0: 5}) == []


def probes():
    rng = np.random.default_rng(0)
    pairs, triples = Counter(), Counter()
    for x in rng.integers(1, 2048, 20_000).tolist():
        pairs.update((x, 2048 - x))
    while sum(triples.values()) < 9_000:
        x, y = rng.integers(512, 1024, 2).tolist()
        if 512 <= 2048 - x - y <= 1024:
            triples.update((x, y, 2048 - x - y))
    return [("pairs", pairs, 20_000, 1.005), ("uniform", {x: 48_700 for x in range(1, 2049)}, 49_893_150, 1.005), ("triples", triples, 3_000, 1.03)]


@pytest.mark.parametrize("name, histogram, optimum, least", probes(), ids=lambda x: x if isinstance(x, str) else "")
def test_known_optima(name, histogram, optimum, least):
    got = P.packed(dict(histogram))
    assert optimum * (1 - 1e-6) <= got.bound <= optimum <= got.containers <= least * optimum
    alone = P._Plan(dict(histogram), 2048)
    alone.best_fit()
    assert got.containers <= alone.used
    if sum(histogram.values()) < 100_000:
        assert check(histogram, 2048, got.rows) == got.containers


@pytest.mark.parametrize("seed", range(6))
def test_bound_against_exhaustive_packing(seed):
    """No packing of few items has fewer containers than the bound."""
    rng = random.Random(seed)
    items = [rng.randrange(3, 20) for _ in range(9)]

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        x, rest = left[0], left[1:]
        tries = [fewest(rest, (*rooms[:i], r - x, *rooms[i + 1 :])) for i, r in enumerate(rooms) if r >= x]
        return min([*tries, fewest(rest, (*rooms, 20 - x))])

    got = P.packed(dict(Counter(items)), 20)
    assert got.bound <= fewest(tuple(sorted(items, reverse=True)), ()) <= got.containers


def test_quality(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word " * 90)], "doc_id bigint, text string")
    row = P.packing_quality(docs, capacity=64).first()
    assert row.pieces == 3 and row.containers == row.bound == 2 and row.gap == 0
    assert P.packing_quality(docs.limit(0), capacity=64).first().containers == 0


def test_containers(spark):
    rng = random.Random(2)
    texts = [None, "", "x" * 3] + [" ".join(["word"] * rng.choice([1, 5, 5, 5, 60, 100, 250])) for _ in range(150)] + ["one two"] * 40
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(7, "again", "clash"), (None, "no id", "clash")], "doc_id bigint, text string, piece string")
    rows = P.containers(docs, capacity=64).collect()
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.n_tokens
    want = Counter()
    for r in P.token_counts(docs).collect():
        want[r.doc_id] += r.n_tokens
    assert whole == want
    filled = Counter()
    for r in rows:
        assert (r.container_id is None) == (r.n_tokens == 0)
        if r.container_id is not None:
            filled[r.container_id] += r.n_tokens
    assert max(filled.values()) <= 64
    cut = Counter(r.doc_id for r in rows if r.piece > 0)
    assert all(want[d] > 64 for d in cut)
    assert P.containers(docs.limit(0)).count() == 0
