import random

import pytest

from tallyweir.llm.spans import shared_characters, sketch_text


def brute(docs, span):
    texts = {}
    for i, t in docs:
        if i is not None and t is not None:
            texts.setdefault(i, []).append(t)
    where = {}
    for i, own in texts.items():
        for t in own:
            for p in range(len(t) - span + 1):
                where.setdefault(t[p : p + span], set()).add(i)
    out = {}
    for i, own in texts.items():
        total = 0
        for t in set(own):
            end = 0
            for p in range(len(t) - span + 1):
                if len(where[t[p : p + span]]) > 1:
                    total += p + span - max(end, p)
                    end = p + span
        if total:
            out[i] = total
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh ", "aé中😀 b"][seed % 3]
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [noise(rng.randrange(10, 120)) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [noise(rng.randrange(0, 30)), p if rng.random() < 0.6 else p[a:b]]
        docs.append((i, "".join(parts)))
    docs += [(50, docs[3][1]), (51, docs[3][1]), (52, None), (53, ""), (54, "aaaa" * 30), (55, "aaaa" * 40), (None, docs[3][1])]
    docs += [docs[5], docs[5], (6, noise(80))]  # repeated rows, and an id with another text
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, lo string")
    got = {r.doc_id: r.shared_chars for r in shared_characters(df, span=30, k=12).collect()}
    assert got == brute(docs, 30)


def test_cuts_between_segments_change_nothing():
    rng = random.Random(9)
    for n in (240, 300, 1000, 3000):
        text = "".join(rng.choice("abcdef ") for _ in range(n))
        whole = sketch_text(text)
        for segment in (1, 7, 50, 333):
            assert all((x == y).all() for x, y in zip(whole, sketch_text(text, segment=segment), strict=True))


def test_nothing_shared(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, "y" * 500), (3, "short")], "doc_id bigint, text string")
    assert shared_characters(df).count() == 0
    assert shared_characters(df.limit(0)).count() == 0


def test_a_passage_in_every_record(spark):
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    boiler = own(400)
    docs = [(i, f"{own(100)}#{i}#{boiler}#{i}#{own(50)}") for i in range(300)]
    got = {r.doc_id: r.shared_chars for r in shared_characters(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(got) == 300 and got == brute(docs, 240)


@pytest.mark.parametrize("length", [120, 240, 1000])
def test_planted_spans_are_all_found(spark, length):
    """Recall and precision at several least lengths: planted passages of just that
    length are found whole, those one character shorter are not."""
    rng = random.Random(length)
    own = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    docs, want = [], {}
    for i in range(0, 80, 2):
        n = length - 1 if i % 8 == 0 else length + rng.randrange(0, 300)
        passage = own(n)
        for j in (i, i + 1):
            docs.append((j, own(rng.randrange(5, 900)) + chr(0x4E00 + j) + passage + chr(0x4E00 + j) + own(rng.randrange(5, 900))))
            if n >= length:
                want[j] = n
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.shared_chars for r in shared_characters(df, span=length, k=min(100, length // 2)).collect()}
    assert got == want


def test_characters_decide_where_hashes_agree(spark):
    """Different passages under one name and extent are told apart by their characters."""
    from tallyweir.llm.spans import _verified

    a, b, c = "a" * 40, "b" * 40, "c" * 40
    rows = [(1, 7, a), (2, 7, b), (3, 7, b), (4, 8, c), (5, 8, c), (6, 9, c)]
    passages = spark.createDataFrame([(t, 0, 0, 10, p, x) for t, p, x in rows], "tid bigint, part int, lo int, hi int, path bigint, passage string")
    assert sorted(r.tid for r in _verified(passages).collect()) == [2, 3, 4, 5]


def test_paths_compact_to_few_runs(spark):
    """A text that occurs twice is one path, however many k-mers it has."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(5000))
    from tallyweir.llm.spans import shared_spans

    runs = shared_spans(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")).collect()
    assert sorted((r.tid, r.lo, r.hi) for r in runs) == [(1, 0, 4760), (2, 0, 4760)]
