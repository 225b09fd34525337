"""Byte-level BPE of whole corpora: two tiers over pre-tokens.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry is resolved by one probe, for a whole batch at a time. Tier two
takes the misses: merges by a heap over linked bytes, once for each distinct
miss of a batch, with a bounded memory of earlier ones.

Pre-tokens are found on the UTF-8 bytes of a batch without a regular expression:
the pattern of the vocabulary only looks at runs of four classes (letters,
numbers, white space, the rest), at the last blank before a run, and at the
English contractions, all of which are array operations.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.session import spread

#: Place of the vocabulary; a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text handled at a time.
CHUNK = 1 << 21
#: Misses remembered by a Python worker.
MEMORY = 200_000
#: Pairs of tokens whose merge a worker remembers.
PAIRS = 1_000_000
#: Entries longer than this are kept beside the perfect hash.
WIDE = 16

_U = np.uint64
_L, _N, _S, _O = range(4)

# Code points of the property White_Space, and the contractions.
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)
# Ranges assigned in Unicode 16, which the vocabulary's libraries know and older tables lack.
UNICODE_16_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
UNICODE_16_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _L, "N": _N}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _O) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = _S
    for ranges, kind in ((UNICODE_16_LETTERS, _L), (UNICODE_16_NUMBERS, _N)):
        for first, last in ranges:
            out[first : last + 1] = kind
    return out


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of each byte; all bytes of a character have the character's class."""
    table = _classes()
    out = table[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = [buf[np.minimum(lead + i, len(buf) - 1)].astype(np.uint32) & 0x3F for i in range(4)]
        first = buf[lead].astype(np.uint32)
        two, three = first < 0xE0, first < 0xF0
        point = np.where(
            two, (first & 0x1F) << 6 | b[1],
            np.where(three, (first & 0x0F) << 12 | b[1] << 6 | b[2], (first & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]),
        )
        kind = table[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        for i, has in ((1, slice(None)), (2, ~two), (3, ~three)):
            out[np.minimum(lead[has] + i, len(buf) - 1)] = kind[has]
    return out


def token_starts(buf: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens begin; ``doc_starts`` are those of the
    non-empty texts that lie one after another in ``buf``."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(buf)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[doc_starts] = True
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    what = kind[run]
    closes = np.zeros(n + 1, bool)  # where a text ends
    closes[doc_starts] = True
    closes[n] = True
    last_of_doc = closes[end]

    last = end - 1  # first byte of the last character
    for _ in range(3):
        last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
    space_run = (what == _S) & ~last_of_doc
    extra = last[space_run & (last > run)]
    attaches = np.zeros(len(run), bool)  # a blank just before belongs to the run
    attaches[1:] = (space_run & (buf[end - 1] == 0x20))[:-1]
    keep = ~attaches

    quote = np.flatnonzero((what == _O) & (end - run == 1) & (buf[run] == 0x27) & keep & ~last_of_doc)
    quote = quote[what[quote + 1] == _L] if len(quote) else quote
    more = []
    if len(quote):
        at, stop = run[quote + 1], end[quote + 1]
        c0, c1 = buf[at], np.where(at + 1 < stop, buf[np.minimum(at + 1, n - 1)], 0)
        length = np.zeros(len(at), np.int64)
        for c in CONTRACTIONS:
            hit = (c0 == ord(c[0])) if len(c) == 1 else (c0 == ord(c[0])) & (c1 == ord(c[1]))
            length[hit & (length == 0)] = len(c)
        hit = length > 0
        keep[quote[hit] + 1] = False
        rest = at[hit] + length[hit]
        more = rest[rest < stop[hit]]
    starts = np.concatenate([run[keep], extra, np.asarray(more, np.int64)])
    starts.sort()
    return starts


class Vocabulary:
    """Ranks of byte strings, with the perfect hash and the merges."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = [self.ranks[bytes([i])] for i in range(256)]
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.wide = {b: i for b, i in self.ranks.items() if len(b) > WIDE}
        self.merges: dict[int, int] = {}
        self.known: dict[bytes, list[int]] = {}
        self._build()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"merges": {}, "known": {}}

    def _build(self) -> None:
        """Hash, displace: buckets in order of size get the first displacement
        that sends their keys to free slots; single keys name their slot."""
        words = [b for b in self.ranks if len(b) <= WIDE]
        n = len(words)
        raw = np.frombuffer(b"".join(b.ljust(WIDE, b"\0") for b in words), "<u8").reshape(n, 2)
        size = np.array([len(b) for b in words], np.uint64)
        h = _mix(raw[:, 0], raw[:, 1], size)
        buckets = n // 2 + 1
        which = (h % _U(buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(buckets + 1))
        counts = np.diff(cuts)
        shift, free = np.zeros(buckets, np.int64), np.ones(n, bool)
        slot_of = np.empty(n, np.int64)
        for b in np.argsort(-counts, kind="stable"):
            if counts[b] <= 1:
                break
            keys = order[cuts[b] : cuts[b + 1]]
            d, tries = 1, 8
            while True:  # many displacements at a time
                s = _slot(h[keys][None, :], np.arange(d, d + tries)[:, None], n)
                good = free[s].all(axis=1)
                if len(keys) > 1:
                    t = np.sort(s, axis=1)
                    good &= (t[:, 1:] != t[:, :-1]).all(axis=1)
                if good.any():
                    first = int(good.argmax())
                    d, s = d + first, s[first]
                    break
                d, tries = d + tries, min(tries * 4, 512)
            shift[b], free[s], slot_of[keys] = d, False, s
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(counts == 1):
            s = next(left)
            shift[b], slot_of[order[cuts[b]]] = -s - 1, s
        self.n, self.buckets, self.shift = n, buckets, shift
        self.keys = np.empty((n, 2), np.uint64)
        self.sizes, self.ids = np.empty(n, np.uint64), np.empty(n, np.int32)
        self.keys[slot_of], self.sizes[slot_of] = raw, size
        self.ids[slot_of] = np.array([self.ranks[b] for b in words], np.int32)

    def probe(self, w0: np.ndarray, w1: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: no entry of at most ``WIDE`` bytes), and the keys' hashes."""
        h = _mix(w0, w1, size)
        d = self.shift[(h % _U(self.buckets)).astype(np.int64)]
        s = np.where(d < 0, -d - 1, _slot(h, d, self.n))
        hit = (self.keys[s, 0] == w0) & (self.keys[s, 1] == w1) & (self.sizes[s] == size)
        return np.where(hit, self.ids[s], -1).astype(np.int32), h

    def merge(self, left: int, right: int) -> int:
        """Id of the merged pair, -1 if there is none."""
        key = left << 32 | right
        got = self.merges.get(key)
        if got is None:
            got = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.merges) < PAIRS:
                self.merges[key] = got
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """Merges by rank: a heap of pairs over bytes linked to their neighbours."""
        got = self.known.get(word)
        if got is not None:
            return got
        n = len(word)
        ids = [self.byte_ids[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        seen, merge, heap = self.merges, self.merge, []
        for i in range(n - 1):
            m = seen.get(ids[i] << 32 | ids[i + 1])
            if m is None:
                m = merge(ids[i], ids[i + 1])
            if m >= 0:
                heap.append(m << 32 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            m, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            now = seen.get(ids[i] << 32 | ids[j])
            if (now if now is not None else merge(ids[i], ids[j])) != m:
                continue  # one of the two has been merged since
            k = after[j]
            ids[i], ids[j], after[i] = m, -1, k
            if k < n:
                before[k] = i
                x = seen.get(m << 32 | ids[k])
                if x is None:
                    x = merge(m, ids[k])
                if x >= 0:
                    push(heap, x << 32 | i)
            h = before[i]
            if h >= 0:
                x = seen.get(ids[h] << 32 | m)
                if x is None:
                    x = merge(ids[h], m)
                if x >= 0:
                    push(heap, x << 32 | h)
        out = [x for x in ids if x >= 0]
        if len(self.known) >= MEMORY:
            self.known.clear()
        if n <= 64:
            self.known[word] = out
        return out


def _mix(w0: np.ndarray, w1: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = (w0 ^ (w0 >> _U(32))) * _U(0x9E3779B97F4A7C15)
    h ^= (w1 + size * _U(0xC2B2AE3D27D4EB4F)) * _U(0x165667B19E3779F9)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = h + np.asarray(d, np.int64).astype(np.uint64) * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    return ((x >> _U(20)) % _U(n)).astype(np.int64)


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[at[i] : at[i] + size[i]], one after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return flat[np.repeat(at - (ends - size), size) + np.arange(total)]


def encode_bytes(v: Vocabulary, buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the texts in ``buf``; for each pre-token its start and number of ids."""
    starts = token_starts(buf, doc_starts)
    size = np.diff(np.append(starts, len(buf)))
    padded = np.concatenate([buf, np.zeros(WIDE, np.uint8)])
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    w0 = words[starts] & _MASKS[np.minimum(size, 8)]
    w1 = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(size > 8)
    w1[long] = words[starts[long] + 8] & _MASKS[np.minimum(size[long] - 8, 8)]
    ids, h = v.probe(w0, w1, size.astype(np.uint64))
    wide = size > WIDE
    ids[wide] = -1
    miss = np.flatnonzero(ids < 0)
    count = np.ones(len(starts), np.int64)
    if not len(miss):
        return ids, starts, count
    # Misses of at most WIDE bytes are told apart by their whole content; wider ones are taken singly.
    narrow = miss[~wide[miss]]
    order = narrow[np.lexsort((size[narrow], w1[narrow], w0[narrow]))]
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        same = (w0[order[1:]] == w0[order[:-1]]) & (w1[order[1:]] == w1[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
        fresh[1:] = ~same
    picked = np.concatenate([order[fresh], miss[wide[miss]]])
    raw = buf.tobytes()
    lists = []
    for s, k in zip(starts[picked].tolist(), size[picked].tolist(), strict=True):
        word = raw[s : s + k]
        whole = v.wide.get(word) if k > WIDE else None
        lists.append([whole] if whole is not None else v.encode_word(word))
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for y in lists for x in y), np.int32, int(lens.sum()))
    at = np.cumsum(lens) - lens
    which = np.zeros(len(starts), np.int64)
    which[order] = np.cumsum(fresh) - 1
    which[picked[int(fresh.sum()) :]] = np.arange(int(fresh.sum()), len(picked))
    count[miss] = lens[which[miss]]
    out = np.empty(int(count.sum()), np.int32)
    place = np.cumsum(count) - count
    hit = ids >= 0
    out[place[hit]] = ids[hit]
    filled = np.repeat(place[miss] - (np.cumsum(count[miss]) - count[miss]), count[miss]) + np.arange(int(count[miss].sum()))
    out[filled] = _ragged(flat, at[which[miss]], count[miss])
    return out, starts, count


def _long_text(v: Vocabulary, buf: np.ndarray, chunk: int) -> np.ndarray:
    """One long text, piece by piece; a piece ends where a pre-token begins that
    no longer piece would place otherwise."""
    parts, a, step = [], 0, chunk
    while a < len(buf):
        b = min(a + step, len(buf))
        while b < len(buf) and (buf[b] & 0xC0) == 0x80:
            b += 1
        ids, starts, count = encode_bytes(v, buf[a:b], np.zeros(1, np.int64))
        if b < len(buf):
            if len(starts) < 8:  # one run fills the piece
                step *= 2
                continue
            kept = len(starts) - 4
            ids, b = ids[: int(count[:kept].sum())], a + int(starts[kept])
        parts.append(ids)
        a, step = b, chunk
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def encode_column(v: Vocabulary, texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, ids, ids per row) of runs of rows; a null text
    has no ids, as an empty one."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lens = np.diff(offsets)
    if texts.null_count:
        lens = np.where(np.asarray(texts.is_null()), 0, lens)
    i = 0
    while i < len(lens):
        j = i + int(np.searchsorted(np.cumsum(lens[i:]), chunk, side="right"))
        if j == i:
            ids = _long_text(v, data[offsets[i] : offsets[i] + lens[i]], chunk)
            yield i, i + 1, ids, np.array([len(ids)])
            i += 1
            continue
        full = np.flatnonzero(lens[i:j])
        if not len(full):
            yield i, j, np.zeros(0, np.int32), np.zeros(j - i, np.int64)
        else:
            # Null slots may hold bytes: texts are joined by their own ranges.
            a, k = offsets[i:j][full], lens[i:j][full]
            joined = int(a[-1] + k[-1] - a[0]) == int(k.sum())
            buf = data[a[0] : a[-1] + k[-1]] if joined else np.concatenate([data[x : x + y] for x, y in zip(a, k, strict=True)])
            begins = np.cumsum(k) - k
            ids, starts, count = encode_bytes(v, buf, begins)
            upto = np.append(0, np.cumsum(count))
            cuts = upto[np.searchsorted(starts, np.append(begins, len(buf)))]
            per = np.zeros(j - i, np.int64)
            per[full] = np.diff(cuts)
            yield i, j, ids, per
        i = j


def _run(shared, only_counts: bool):
    def run(batches):
        v = shared.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i, j, ids, per in encode_column(v, texts):
                if only_counts:
                    value = pa.array(per, pa.int64())
                else:
                    cuts = np.append(0, np.cumsum(per)).astype(np.int32)
                    value = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), value], names=["key", "value"])

    return run


def _mapped(documents: DataFrame, doc_id: str, text: str, path: str, only_counts: bool) -> DataFrame:
    """The vocabulary is built once and broadcast; its size is that of its file."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))
    plain = documents.select(F.col(doc_id).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return spread(plain, "key").mapInArrow(_run(shared, only_counts), f"key bigint, value {'bigint' if only_counts else 'array<int>'}")


def encoded(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every row: its text's ids, without special tokens.

    Null and empty texts have the empty list. Strings that look like special
    tokens are ordinary text. Rows without id keep a null id; rows that repeat
    an id come out as often. Other columns are not read.
    """
    return _mapped(documents, doc_id, text, path, False).select(F.col("key").alias("doc_id"), F.col("value").alias("ids"))


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every row; null and empty texts have 0."""
    return _mapped(documents, doc_id, text, path, True).select(F.col("key").alias("doc_id"), F.col("value").alias("n_tokens"))
