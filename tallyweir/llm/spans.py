"""Long exact spans shared between records, by de Bruijn compaction.

An edge of the graph is a k-mer of ``SPAN`` characters, its nodes are what it
shares with its neighbours. Edges are not written one by one: the k-mers of a
text that have the same minimizer (of the ``ANCHOR``-character pieces in them the
one with the least hash) follow each other and travel as one piece, cut where the
minimizer changes. Whoever shares a k-mer shares its minimizer at the same place,
so nothing is missed.

1. Minimizers met in two or more records are kept. Where all their pieces are
   equal, the pieces stand for their k-mers; where they differ the graph
   branches, and there the single k-mers are compared.
2. A join gives every piece or k-mer its degrees: whether all its occurrences have
   one successor, and one predecessor. A link is nonbranching if it is the only
   one on both its sides. Maximal runs of nonbranching links are paths; as a path
   has the same extent wherever it occurs, its occurrences are read off at their
   source coordinates, in one sorted pass and without a join per doubling.
3. The characters at the source coordinates of every piece, and of every path of
   single k-mers, are compared: hashes only propose, characters decide. Should
   different characters have met under one hash, they are told apart by the
   characters themselves.

No pair of records is ever formed: each step is an aggregation that keeps the
least and the greatest record of a key, so a passage in a third of all records
costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweir.llm.hashing import Prefix, code_points
from tallyweir.session import forget, spread, written

SPAN = 240
ANCHOR = 100
#: Window starts of a text handled at a time; bounds memory for texts of any length.
SEGMENT = 1 << 13
#: Bits of a hash that give way to a place within a segment; hashes are compared by the others.
PLACE_BITS = 20

_SKETCH = pa.schema([("tid", pa.int64()), ("part", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("node", pa.int64()), ("edge", pa.int64())])
_PIECES = pa.schema([("tid", pa.int64()), ("part", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("id", pa.int64()), ("flags", pa.int32()), ("passage", pa.string())])
_KMERS = pa.schema([("tid", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("lo", pa.int32()), ("id", pa.int64()), ("near", pa.int64())])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least hash of each window of ``width`` lies, the leftmost of equals.

    The low bits of the hashes give way to the place, and minima of windows of
    doubled width are taken until two of them cover one of ``width``.
    """
    bits = np.uint64(PLACE_BITS)  # the same for all texts, or equal windows could pick differently
    m = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def sketch_text(text: str, span: int = SPAN, k: int = ANCHOR, segment: int = SEGMENT):
    """Anchors of one text: the window starts [lo, hi] each one is the anchor of,
    node hashes and edge hashes. An anchor on both sides of a cut between segments
    is split at the cut's window only if the text is longer than a segment; its
    parts are joined again."""
    if segment + span > 1 << PLACE_BITS:
        raise ValueError("segments are too long for their places")
    points = code_points(text)
    starts, width = len(points) - span + 1, span - k + 1
    out: list[list[np.ndarray]] = []
    for a in range(0, max(starts, 0), segment):
        b = min(a + segment, starts)
        part = Prefix(points[a : b + 2 * span])
        h = part.windows(k)
        picks = _least(h[: b - a + width - 1], width)
        first = np.flatnonzero(np.diff(picks, prepend=-1))
        p, last = picks[first], np.append(first[1:], len(picks)) - 1
        got = [p + a, first + a, last + a, h[p], part.spans(first, last + span)]
        if out and out[-1][0][-1] == got[0][0]:
            # One anchor on both sides: no longer than a window apart, so its text is hashed anew.
            lo, hi = int(out[-1][1][-1]), int(got[2][0])
            whole = Prefix(points[lo : hi + span]).spans(np.zeros(1, np.int64), np.array([hi + span - lo]))
            out[-1][2][-1], out[-1][4][-1] = hi, whole[0]
            got = [x[1:] for x in got]
        if len(got[0]):
            out.append(got)
    return tuple(np.concatenate(x) for x in list(zip(*out, strict=True))[1:]) if out else None


def _sketches(span: int, k: int, segment: int):
    def run(batches):
        for batch in batches:
            ids, marks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            got, held = [], 0
            for i in range(len(ids)):
                one = sketch_text(texts[i].as_py(), span, k, segment)
                if one is not None:
                    got.append((np.full(len(one[0]), ids[i]), np.full(len(one[0]), marks[i]), *one))
                    held += len(one[0])
                if held > 200_000 or (i == len(ids) - 1 and got):
                    t, m, lo, hi, n, e = (np.concatenate(x) for x in zip(*got, strict=True))
                    cols = [t, m, lo.astype(np.int32), hi.astype(np.int32), n.view(np.int64), e.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_SKETCH)
                    got, held = [], 0

    return run


def _neighbours(h: np.ndarray) -> np.ndarray:
    """32 bits each of the next hash (high half) and the previous one (low half) of
    k-mers that follow each other; 0 at the ends."""
    half = (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    out = np.zeros(len(h), np.uint64)
    out[:-1] |= half[1:] << np.uint64(32)
    out[1:] |= half[:-1]
    return out


def _cut_pieces(span: int):
    """The characters of the pieces at their source coordinates."""

    def run(batches):
        for batch in batches:
            ids, marks, texts, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            rows, held = [], 0
            for i, tid in enumerate(ids):
                text = texts[i].as_py()
                for r in lists[i].as_py():
                    rows.append((tid, marks[i], r["lo"], r["hi"], r["id"], r["flags"], text[r["lo"] : r["hi"] + span]))
                    held += len(rows[-1][6])
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return run


def _kmers(span: int):
    """The k-mers of pieces ``(tid, part, lo, passage)``, with their neighbours in the piece."""

    def run(batches):
        for batch in batches:
            ids, marks, starts, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            out, held = [], 0
            for i, tid in enumerate(ids):
                h = Prefix(code_points(texts[i].as_py())).windows(span)
                at = np.arange(len(h), dtype=np.int32) + np.int32(starts[i])
                out.append((np.full(len(h), tid), np.full(len(h), marks[i]), np.full(len(h), starts[i]), at, h.view(np.int64), _neighbours(h).view(np.int64)))
                held += len(h)
                if held > 200_000 or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_KMERS)
                    out, held = [], 0

    return run


_LOW = 0xFFFFFFFF


def _ends() -> list[Column]:
    return [F.min("tid").alias("t0"), F.max("tid").alias("t1")]


def _degrees(pieces: DataFrame) -> DataFrame:
    """``id, t0, t1, out, inn``: the least and greatest record a piece is met in,
    and whether all its occurrences have one and the same successor, predecessor."""
    half = lambda c, high: F.shiftrightunsigned(c, 32) if high else F.col(c).bitwiseAND(F.lit(_LOW))
    one = lambda high: (half("every", high) == half("some", high)) & (half("every", high) != 0)
    found = pieces.groupBy("id").agg(*_ends(), F.bit_and("near").alias("every"), F.bit_or("near").alias("some"))
    return found.select("id", "t0", "t1", one(True).alias("out"), one(False).alias("inn"))


def _beside(pieces: DataFrame) -> DataFrame:
    """``pieces(tid, part, lo, hi, id, ...)``, each once, with ``near`` as the
    k-mers have it. One sorted pass over each text."""
    order = W.partitionBy("tid", "part").orderBy("lo")
    half = lambda c: c.bitwiseAND(F.lit(_LOW)).bitwiseOR(F.lit(1).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    after = F.when(F.lead("lo").over(order) == F.col("hi") + 1, F.shiftleft(half(F.lead("id").over(order)), 32)).otherwise(zero)
    before = F.when(F.lag("hi").over(order) == F.col("lo") - 1, half(F.lag("id").over(order))).otherwise(zero)
    return pieces.repartition("tid", "part").dropDuplicates(["tid", "part", "lo"]).withColumn("near", after.bitwiseOR(before))


def _paths(pieces: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """``within..., lo, hi, path``: the maximal runs of nonbranching links, named by
    their first piece, of ``pieces(within..., lo, hi, id, out, inn)``."""
    order = W.partitionBy(*within).orderBy("lo")
    linked = (F.lag("hi").over(order) == F.col("lo") - 1) & F.lag("out").over(order) & F.col("inn")
    begins = F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)
    single = pieces.repartition(*within[:2]).dropDuplicates([*within, "lo"])
    runs = single.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    head = F.max(F.when(F.col("begins") == 1, F.col("id"))).alias("path")
    return runs.groupBy(*within, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), head).select(*within, "lo", "hi", "path")


def _verified(passages: DataFrame) -> DataFrame:
    """The rows of ``passages(path, passage, tid, part, lo, hi, ...)``, without the
    characters, whose characters occur in two or more records under their name and
    extent. Equal passages are combined before they are shuffled; each moves once
    more only if different characters share a name and extent."""
    key = ["path", "windows"]
    passages = passages.withColumn("windows", F.col("hi") - F.col("lo"))
    distinct = passages.groupBy(*key, "passage").agg(*_ends())
    named = written(distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"), F.min("t0").alias("t0"), F.max("t1").alias("t1")), "named")
    sure = passages.drop("passage").join(named.where("texts = 1 and t0 < t1"), key, "left_semi").drop("windows")
    mixed = named.where("texts > 1").select(*key)
    if mixed.isEmpty():
        return sure
    again = passages.join(mixed, key, "left_semi")
    apart = again.join(again.groupBy(*key, "passage").agg(*_ends()).where("t0 < t1").drop("t0", "t1"), [*key, "passage"], "left_semi")
    return sure.unionByName(apart.drop("passage", "windows"))


def shared_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, k: int = ANCHOR, segment: int = SEGMENT) -> DataFrame:
    """``tid, part, lo, hi``: ranges of starts of ``span``-character windows that
    occur in at least one other record. ``part`` tells apart the texts of an id.

    Records are told apart by ``doc_id``: rows that repeat an id are one record,
    which does not share with itself. Rows without id, and texts that are null or
    shorter than ``span``, share nothing. Runs that recur only within one record
    don't count. Other columns are not read.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("tid"), F.hash(text).alias("part"), F.col(text).cast("string").alias("text")).where(
        F.col("tid").isNotNull() & (F.length("text") >= span)
    )
    sketch = written(spread(docs, "tid").mapInArrow(_sketches(span, k, segment), "tid bigint, part int, lo int, hi int, node bigint, edge bigint"), "sketch")
    nodes = (
        sketch.groupBy("node").agg(*_ends(), F.min("edge").alias("e0"), F.max("edge").alias("e1")).where("t0 < t1")
        .select("node", F.expr("e0 <> e1").alias("branches"))
    )
    met = written(_beside(sketch.join(nodes, "node").withColumnRenamed("edge", "id").drop("node")), "met")
    forget(sketch)
    # Flags of a piece: 1 its k-mers are asked for, 2 it is met in two records, 4 one successor, 8 one predecessor.
    asked, repeated = F.expr("branches and (t0 = t1 or tid = t0 or tid = t1)"), F.expr("t0 < t1")
    flags = sum((F.when(c, bit).otherwise(0) for bit, c in ((1, asked), (2, repeated), (4, F.col("out")), (8, F.col("inn")))), F.lit(0)).alias("flags")
    wanted = met.join(_degrees(met), "id").select("tid", "part", "lo", "hi", "id", flags).where("flags & 3 <> 0")
    lists = written(wanted.groupBy("tid", "part").agg(F.collect_list(F.struct("lo", "hi", "id", "flags")).alias("pieces")), "pieces-of-texts")  # no longer than the text
    # Names of the texts wanted, a small table: where Spark finds it small enough to broadcast, only those texts
    # move; where not, texts move once, as both joins have the same keys.
    names = written(lists.select("tid", "part"), "names-of-texts")
    held = docs.join(names, ["tid", "part"], "left_semi").join(lists, ["tid", "part"]).select("tid", "part", "text", "pieces")
    pieces = written(held.mapInArrow(_cut_pieces(span), "tid bigint, part int, lo int, hi int, id bigint, flags int, passage string"), "pieces")
    forget(met, lists, names)
    # Computed twice, once for the degrees and once for the places: cheaper than to write them.
    kmers = pieces.where("flags & 1 <> 0").select("tid", "part", "lo", "passage").mapInArrow(_kmers(span), "tid bigint, part int, piece int, lo int, id bigint, near bigint")
    single = kmers.drop("near").join(_degrees(kmers).where("t0 < t1"), "id").withColumn("hi", F.col("lo"))
    runs = written(_paths(single.select("tid", "part", "piece", "lo", "hi", "id", "out", "inn"), ("tid", "part", "piece")), "runs")
    source = pieces.where("flags & 1 <> 0").select("tid", "part", F.col("lo").alias("piece"), F.col("passage").alias("around")).dropDuplicates(["tid", "part", "piece"])
    part_of = F.substr("around", F.col("lo") - F.col("piece") + 1, F.col("hi") - F.col("lo") + span).alias("passage")
    branching = runs.join(source, ["tid", "part", "piece"]).select("tid", "part", "lo", "hi", "path", part_of)
    plain = pieces.where("flags & 2 <> 0").withColumn("path", F.col("id"))
    proven = _verified(plain).select("tid", "part", "lo", "hi", "id", F.expr("flags & 4 <> 0").alias("out"), F.expr("flags & 8 <> 0").alias("inn"))
    compact = _paths(proven, ("tid", "part")).select("tid", "part", "lo", "hi")
    return compact.unionByName(_verified(branching).select("tid", "part", "lo", "hi"))


def shared_characters(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, k: int = ANCHOR) -> DataFrame:
    """``doc_id, shared_chars`` of each record that shares a span: the characters
    (code points) that lie in shared windows, each counted once."""
    spans = shared_spans(documents, doc_id, text, span, k)
    order = W.partitionBy("tid", "part").orderBy("lo", "hi")
    before = F.max(F.col("hi") + span).over(order.rowsBetween(W.unboundedPreceding, -1))
    end = F.col("hi") + span
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("lo"), F.coalesce(before, F.lit(0))))
    return spans.withColumn("fresh", fresh).groupBy(F.col("tid").alias("doc_id")).agg(F.sum(F.col("fresh").cast("bigint")).alias("shared_chars"))
