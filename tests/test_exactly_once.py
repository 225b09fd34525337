import random
from collections import Counter

from tallyweir.streaming.exactly_once import DeliveryLog, run_dedupe

SCHEMA = "delivery_id bigint, delivered_at timestamp, accession string, cik string, acceptance_datetime string, batch_id bigint, at string"


def frame(spark, rows):
    full = [(i, None, a, c, t, None, "clash") for i, a, c, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumn("delivered_at", df["delivered_at"])


def truth(rows):
    first, out = {}, []
    for i, a, c, _ in sorted(rows, key=lambda r: r[0]):
        acc, cik = "".join(x for x in a or "" if x.isdigit()), "".join(x for x in c or "" if x.isdigit()).lstrip("0")
        if not acc or not cik:
            continue
        if (acc, cik) in first:
            out.append((first[acc, cik], i))
        else:
            first[acc, cik] = i
    return Counter(out), len(first)


def test_batches_in_any_order_with_expiry(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for i in range(1, 400):
        k = rng.randrange(60)
        acc = rng.choice([f"00000000{k:02d}-20-000001", f"00000000{k:02d}20000001", f" 00000000{k:02d}-20-000001\n"])
        cik = rng.choice([f"{k:010d}", f"CIK{k:010d}"]) if k else "0000000100"
        rows.append((i, rng.choice([acc] * 9 + [None, ""]), rng.choice([cik] * 12 + [None]), f"20{rng.randrange(10, 25)}-01-{rng.randrange(1, 28):02d}T00:00:00Z"))
    for shuffled in (False, True):
        log = DeliveryLog(spark, f"file://{tmp_path}/{shuffled}", horizon_seconds=86_400)
        order = rows[:]
        if shuffled:
            rng.shuffle(order)
        for b in range(4):
            log.process(frame(spark, order[b * 100 : b * 100 + 100]), b)
        want, kept = truth(rows)
        assert Counter(map(tuple, log.copies().collect())) == want
        assert log.survivors().count() == kept
        assert log._read("archive", "acc string, cik string, first_id bigint, at timestamp", log.committed()).count() > 0  # something did expire


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows = [(1, "1", "1", None), (2, "1", "1", None), (3, "2", "1", None)]
    log = DeliveryLog(spark, f"file://{tmp_path}/again")
    log.process(frame(spark, rows), 0)
    before = log.copies().collect()
    log.process(frame(spark, rows), 0)
    assert log.copies().collect() == before and log.committed() == [0]


def test_uncommitted_output_is_not_seen(spark, tmp_path):
    log = DeliveryLog(spark, f"file://{tmp_path}/torn")
    log.process(frame(spark, [(1, "1", "1", None)]), 0)
    (tmp_path / "torn" / "commits" / "000000000").unlink()
    assert log.committed() == [] and log.copies().count() == 0
    log.process(frame(spark, [(1, "1", "1", None), (2, "1", "1", None)]), 0)
    assert [tuple(r) for r in log.copies().collect()] == [(1, 2)]


def test_empty_batch(spark, tmp_path):
    log = DeliveryLog(spark, f"file://{tmp_path}/empty")
    log.process(frame(spark, []), 0)
    assert log.copies().count() == 0 and log.survivors().count() == 0


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    src = f"{tmp_path}/feed"
    frame(spark, [(1, "1", "1", None), (2, "2", "1", None), (3, "1", "1", None)]).coalesce(1).write.parquet(src)
    root = f"file://{tmp_path}/job"
    schema = spark.read.parquet(src).schema
    assert [tuple(r) for r in run_dedupe(spark, src, schema, root).copies().collect()] == [(1, 3)]
    frame(spark, [(4, "2", "1", None)]).coalesce(1).write.mode("append").parquet(src)
    assert sorted(map(tuple, run_dedupe(spark, src, schema, root).copies().collect())) == [(1, 3), (2, 4)]


def test_many_batches_with_rewritten_state(spark, tmp_path, monkeypatch):
    """The state is rewritten on the way; nothing is lost, whatever has expired."""
    from tallyweir.streaming import exactly_once as X

    monkeypatch.setattr(X, "COMPACT", 2)
    rng = random.Random(3)
    rows = [(i, f"00000000{k:02d}-{rng.choice(['20', '21'])}-000001", str(k + 1), f"2020-01-{1 + i // 12:02d}T00:00:00Z") for i in range(1, 240) for k in [rng.randrange(40)]]
    order = rows[:]
    rng.shuffle(order)
    log = DeliveryLog(spark, f"file://{tmp_path}/many", horizon_seconds=3 * 86_400)
    for b in range(6):
        log.process(frame(spark, order[b * 40 : b * 40 + 40]), b)
    want, kept = truth(rows)
    assert Counter(map(tuple, log.copies().collect())) == want and log.survivors().count() == kept
    assert log._last()[1] == 4
