import random

import numpy as np
import pyarrow as pa
import pytest

from tallyweir.llm import tokenizer as T

tiktoken = pytest.importorskip("tiktoken")
PIECES = ["'s", "'", "''", " ", "  ", "\n", "\t", " 's", "'re", "'ll", "'LL", "a", "é", "٣", "12", "中", "　", "\xa0", "😀", "!", "...", "don't", "'stuff", "\r\n", " \n x", "\x1c", "ⅷ", "̈", "\x85", "<|endoftext|>", "\x00"]


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P

    v = T.vocabulary()
    return v, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def encode(v, texts, chunk=T.CHUNK):
    out = []
    for i, j, ids, per in T.encode_column(v, pa.array(texts, pa.string()), chunk):
        cuts = np.append(0, np.cumsum(per))
        out += [ids[cuts[k] : cuts[k + 1]].tolist() for k in range(j - i)]
    return out


def test_hash_is_minimal_and_perfect(both):
    v, _ = both
    words = [b for b in v.ranks if len(b) <= T.WIDE]
    assert v.n == len(words) == len(set(v.ids.tolist()))
    raw = np.frombuffer(b"".join(b.ljust(T.WIDE, b"\0") for b in words), "<u8").reshape(-1, 2)
    ids, _ = v.probe(raw[:, 0].copy(), raw[:, 1].copy(), np.array([len(b) for b in words], np.uint64))
    assert ids.tolist() == [v.ranks[b] for b in words]


@pytest.mark.parametrize("chunk", [T.CHUNK, 16])
def test_against_public_library(both, chunk):
    v, other = both
    rng = random.Random(5)
    for _ in range(400):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(15))) if rng.random() > 0.1 else None for _ in range(5)]
        assert encode(v, texts, chunk) == [other.encode_ordinary(t or "") for t in texts]


def test_every_code_point_has_the_library_s_class(both):
    """A quote after a character begins a contraction unless both are marks."""
    v, other = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x20]
    texts = [f"x{chr(c)}'s" for c in points]
    whole = v.ranks[b"'s"]
    assert [e[-1] == whole for e in other.encode_ordinary_batch(texts, num_threads=4)] == [T._classes()[c] != T._O for c in points]
    sample = [chr(c) + "1" + chr(c) + "a " + chr(c) for a, b in (*T.UNICODE_16_LETTERS, *T.UNICODE_16_NUMBERS) for c in (a, b)]
    assert encode(v, sample) == [other.encode_ordinary(t) for t in sample]


def test_long_texts_and_words(both):
    v, other = both
    rng = random.Random(6)
    for text in ("a" * 5000, " " * 3000 + "x", "antidisestablishmentarianism" * 40, "".join(rng.choice(PIECES) for _ in range(20_000)), "=" * 64 + "-" * 33):
        assert encode(v, [text], 512) == [other.encode_ordinary(text)]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world", 9), (1, "Hello world", 9), (2, "", 9), (3, None, 9), (None, "x", 9)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in T.encoded(docs).collect())
    assert got == [(0, [87]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in T.token_counts(docs).collect()) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert T.encoded(docs.limit(0)).count() == 0


def test_pairs_of_large_ids_are_told_apart():
    """Keys of pairs leave no room for two pairs to meet, whatever the vocabulary's size."""
    v = T.vocabulary()
    assert len({(a << 32 | b) for a in (1, 2, 1 << 18, (1 << 18) + 1) for b in (0, 1 << 17, 1 << 18, (1 << 31) - 1)}) == 16
    assert v.merge(v.byte_ids[ord("t")], v.byte_ids[ord("h")]) == v.ranks[b"th"]
