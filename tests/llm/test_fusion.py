import datetime as dt
import random
import re

import numpy as np

from tallyweir.llm import fusion as U

SCHEMA = "fact_id bigint, cik string, tag string, unit string, context_id string, val double, accession string, filed date, end_date date, origin string, rank int, g int"
TRUST = [("a", 90), ("b", 60), ("c", 60), ("d", None), ("a", 10), (None, 99)]


def brute(rows):
    trust = {"a": 90, "b": 60, "c": 60, "d": 0}
    groups = {}
    for r in rows:
        i, cik, tag, unit, context = r[:5]
        digits = re.search(r"\d+", cik or "")
        if i is None or digits is None or None in (tag, unit, context):
            continue
        key = (int(digits[0]), re.sub(r"^(us-gaap|ifrs-full|dei)[:_]", "", tag.strip().lower()), re.sub(r"^iso4217:", "", unit.strip().lower()), context.strip().lower())
        groups.setdefault(key, []).append(r)
    out = []
    for own in groups.values():
        if len(own) < 2:
            continue

        def pick(ok, own=own):
            good = [r for r in own if ok(r)]
            return max(good, key=lambda r: (trust.get(r[9], 0), r[7] or dt.date.min, r[0]))[0] if good else -1

        accession = lambda r: bool(re.fullmatch(r"\d{10}-\d\d-\d{6}|\d{18}", (r[6] or "").strip())) and set(r[6]) - set("0- ")
        out.append((min(r[0] for r in own), pick(lambda r: r[5] is not None and r[5] == r[5]), pick(accession), pick(lambda r: r[7]), pick(lambda r: r[8] and (r[7] is None or r[8] <= r[7]))))
    return sorted(out)


def sample(n, seed=1):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, dt.date(2020, rng.randrange(1, 13), 5)])
    return [
        (
            rng.choice([i, i, i, i, 3, None]), rng.choice(["0000000007", "7", "CIK0000000007 ", "8", None, "x"]), rng.choice(["Assets", "us-gaap:Assets", " assets", "dei_Assets", None]),
            rng.choice(["USD", "iso4217:usd", " usd"]), rng.choice(["c1", "C1 ", "c2", None]), rng.choice([None, float("nan"), 1.0, 2.0, -0.0, 0.0]),
            rng.choice([None, "", "N/A", "0000000000-00-000000", "0000000001-20-000001", "000000000120000002"]), day(), day(), rng.choice(["a", "b", "c", "d", "z", None]), 1, 2,
        )
        for i in range(n)
    ]


def test_found_against_brute_force(spark):
    rows = sample(500) + sample(40)
    facts, origins = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(TRUST, "origin string, trust int")
    assert sorted(map(tuple, U.best_sources(facts, origins).collect())) == brute(rows)


def test_empty_tables(spark):
    facts, origins = spark.createDataFrame(sample(50), SCHEMA), spark.createDataFrame([], "origin string, trust int")
    assert U.best_sources(facts.limit(0), origins).count() == 0
    assert U.best_sources(facts, origins).count() > 0
    assert U.true_values(facts.limit(0), origins).count() == 0
    assert U.source_quality(facts.limit(0), origins).count() == len(U.FIELDS)


def test_model_recovers_planted_quality():
    rng = np.random.default_rng(2)
    se, sp = np.array([0.95, 0.9, 0.6, 0.85]), np.array([0.97, 0.9, 0.8, 0.6])
    counts = {}
    for _ in range(40_000):
        cover = 15
        truth = rng.random() < 0.5
        state = rng.random(4) < np.where(truth, se, 1 - sp)
        mask = int((state * (1 << np.arange(4))).sum())
        counts[mask] = counts.get(mask, 0) + 1
    q = U.fit([(0, cover, m, n) for m, n in counts.items()], (None, "a", "b", "c"), (0, 1, 2, 3), rounds=300)
    assert np.abs(q.sensitivity[0] - se).max() < 0.05 and np.abs(q.specificity[0] - sp).max() < 0.05
    assert q.posterior(0, 15, 15) > 0.95 > 0.05 > q.posterior(0, 15, 0)


def planted(spark, groups=400, seed=11, names=("a", "b", "c", "d")):
    """Facts of sources of known sensitivity and specificity; some groups have two true values."""
    rng = random.Random(seed)
    se = [0.95, 0.9, 0.85, 0.6][: len(names)] + [0.8] * (len(names) - 4)
    sp = [0.98, 0.95, 0.9, 0.6][: len(names)] + [0.9] * (len(names) - 4)
    rows, truth = [], {}
    for g in range(groups):
        true = [100.0 + g, 900.0 + g][: 1 + (g % 4 == 0)]
        wrong = [g + 0.25, g + 0.5, g + 0.75]
        first = len(rows)
        for s, name in enumerate(names):
            said = [v for v in true if rng.random() < se[s]] + [v for v in wrong if rng.random() > sp[s]]
            rows += [(len(rows) + i, str(g), "t", "u", "c", v, None, None, None, name, 0, 0) for i, v in enumerate(said)]
        if len(rows) - first > 1:
            truth[first] = {str(v) for v in true}
    return spark.createDataFrame(rows, SCHEMA), truth


def test_planted_truths_are_found(spark):
    facts, truth = planted(spark)
    origins = spark.createDataFrame([(x, 1) for x in "abcd"], "origin string, trust int")
    got = {}
    for r in U.true_values(facts, origins).where("field = 'val'").collect():
        got.setdefault(r.group_id, set()).add(r.value)
    both = sum(len(got.get(g, set()) & t) for g, t in truth.items())
    assert both / sum(map(len, got.values())) >= 0.9  # precision
    assert both / sum(map(len, truth.values())) >= 0.9  # recall, of several true values too
    best = {r.group_id: r for r in U.best_records(facts, origins).collect()}
    assert set(best) == set(truth)
    assert sum(best[g].val in t for g, t in truth.items()) >= 0.97 * len(truth)
    assert all(r.accession is None and r.filed is None and r.end_date is None for r in best.values())


def test_model_outweighs_trust_in_records(spark):
    """A source of high trust that is mostly alone in what it says loses to those that agree."""
    rows = []
    for g in range(200):
        said = [("liar", float(g) if g % 10 == 0 else -1.0 - g), ("b", float(g)), ("c", float(g)), ("d", float(g))]
        rows += [(len(rows) + i, str(g), "t", "u", "c", v, None, None, None, s, 0, 0) for i, (s, v) in enumerate(said)]
    facts = spark.createDataFrame(rows, SCHEMA)
    origins = spark.createDataFrame([("liar", 99), ("b", 1), ("c", 1), ("d", 1)], "origin string, trust int")
    assert {float(r.val) for r in U.best_records(facts, origins).collect()} == {float(g) for g in range(200)}


def test_more_sources_than_a_word_holds(spark):
    names = tuple(f"s{i:03d}" for i in range(130))
    facts, truth = planted(spark, 40, names=names)
    origins = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "origin string, trust int")
    best = {r.group_id: r.val for r in U.best_records(facts, origins).collect()}
    assert all(best[g] in t for g, t in truth.items())
    assert U.best_sources(facts, origins).count() == len(truth)


def test_a_long_histogram_is_fitted_where_it_lies(spark, monkeypatch):
    facts, _ = planted(spark, 60)
    origins = spark.createDataFrame([(x, 1) for x in "abcd"], "origin string, trust int")
    here = U.learn(U.prepared(facts), origins)
    monkeypatch.setattr(U, "HERE", 3)
    there = U.learn(U.prepared(facts), origins)
    assert np.allclose(here.sensitivity, there.sensitivity) and np.allclose(here.specificity, there.specificity) and np.allclose(here.prior, there.prior)


def test_several_values_can_be_true(spark):
    rows = []
    for g in range(60):
        for s in "abc":
            for v in (1.0, 2.0) if g < 30 else (1.0,):
                rows.append((len(rows), str(g), "t", "u", "c", v, None, None, None, s, 0, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    origins = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "origin string, trust int")
    got = U.true_values(df, origins).where("field = 'val'").groupBy("group_id").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 30, 2: 30}


def test_picks_come_from_the_judged_values(spark):
    """The declared order names the row, the model says how likely its value is true."""
    rows = []
    for g in range(200):
        said = [("liar", float(g) if g % 10 == 0 else -1.0 - g), ("b", float(g)), ("c", float(g)), ("d", float(g))]
        rows += [(4 * g + i, str(g), "t", "u", "c", v, None, None, None, s, 0, 0) for i, (s, v) in enumerate(said)]
    facts = spark.createDataFrame(rows, SCHEMA)
    origins = spark.createDataFrame([("liar", 99), ("b", 1), ("c", 1), ("d", 1)], "origin string, trust int")
    got = U.picked(facts, origins).collect()
    assert {(r.group_id, r.val_id) for r in got} == {(4 * g, 4 * g) for g in range(200)}
    assert all((r.val_posterior > 0.5) == (r.group_id % 40 == 0) for r in got)
    assert all(r.filed_id == -1 and r.filed_posterior is None for r in got)
    held = {(r.group_id, float(r.value)): r.posterior for r in U.judged(facts, origins).where("field = 0").collect()}
    assert max(abs(r.val_posterior - held[r.group_id, rows[r.val_id][5]]) for r in got) < 1e-9


def test_found_is_fitted_on_all_rows(spark, monkeypatch):
    fitted, fit = [], U.fit
    monkeypatch.setattr(U, "fit", lambda *given: fitted.append(fit(*given)) or fitted[-1])
    rows = sample(300, 5)
    facts, origins = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(TRUST, "origin string, trust int")
    assert sorted(map(tuple, U.best_sources(facts, origins).collect())) == brute(rows)
    assert len(fitted) == 1 and fitted[0].stated.sum() > 0
    all_rows = U.learn(U.prepared(facts), origins)
    assert np.array_equal(fitted[0].stated, all_rows.stated)
    assert np.allclose(fitted[0].sensitivity, all_rows.sensitivity) and np.allclose(fitted[0].specificity, all_rows.specificity)


def test_groups_without_a_usable_value_are_found(spark):
    rows = [(i, str(i // 2), "t", "u", "c", None, "N/A", None, None, "a", 0, 0) for i in range(6)] + [(7, "1", "t", "u", "c", 3.0, None, None, None, None, 0, 0)]
    facts, origins = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(TRUST, "origin string, trust int")
    assert sorted(map(tuple, U.best_sources(facts, origins).collect())) == [(0, -1, -1, -1, -1), (2, 7, -1, -1, -1), (4, -1, -1, -1, -1)]
    assert U.true_values(facts, origins).count() <= 1
