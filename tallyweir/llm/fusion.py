"""One best record for each group of duplicate facts.

Sources are judged by a latent two-sided model: of each source and field the
sensitivity (it states a value that is true) and the specificity (it does not
state one that is false) are estimated by expectation-maximisation over all
stated values. A field may keep every value judged true (``true_values``), and the
surviving record takes of each field the value most likely true (``best_records``).

The likelihood depends on a value only through the set of sources that cover its
group and the set that state it. So the corpus is reduced, by partial
aggregations alone, to a histogram of such patterns. No group is ever gathered in
one task. A histogram of up to ``HERE`` patterns is fitted on the driver, a longer
one by one aggregation a round; both take the same step.

``best_sources`` picks among the same judged values. The order it is given is
declared and complete, so it comes before the posterior and no posterior can
change a pick; ``picked`` tells of each pick how likely the model holds it true.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.keys import accession_18, cik_number, context_key, tag_key, unit_key
from tallyweir.session import forget, spread, written

#: The fields of a fused fact.
FIELDS = ("val", "accession", "filed", "end_date")
#: Sources in one bigint of a set of sources; larger sets take several.
WORD = 62
#: Patterns fitted on the driver; more of them stay a table.
HERE = 1 << 16
ROUNDS = 40


@dataclass(frozen=True)
class SourceQuality:
    """What the model learned: arrays [field, source] and the prior of truth.
    Source 0 stands for all origins without declared trust."""

    sources: tuple[str | None, ...]
    trust: tuple[int, ...]
    sensitivity: np.ndarray
    specificity: np.ndarray
    prior: np.ndarray
    stated: np.ndarray

    def weight(self) -> np.ndarray:
        """Log likelihood ratio by which a statement of the source speaks for truth."""
        return np.log(self.sensitivity) - np.log1p(-self.specificity)

    def posterior(self, field: int, cover: int, mask: int) -> float:
        """Probability that a value is true which ``mask`` state and ``cover`` could."""
        sets = lambda x: np.array([x >> j & 1 for j in range(len(self.sources))])
        state, silent = sets(mask), sets(cover & ~mask)
        se, sp = self.sensitivity[field], self.specificity[field]
        yes = np.log(self.prior[field]) + (state * np.log(se) + silent * np.log1p(-se)).sum()
        no = np.log1p(-self.prior[field]) + (state * np.log1p(-sp) + silent * np.log(sp)).sum()
        return float(1 / (1 + np.exp(no - yes)))


def prepared(facts: DataFrame) -> DataFrame:
    """Group keys, and each field where it is usable, of rows that have all keys.

    Usable: ``val`` neither null nor NaN; ``accession`` of 18 digits, not all zero;
    ``filed`` not null; ``end_date`` not null and not after the row's ``filed``.
    """
    filed, end = F.col("filed").cast("date"), F.col("end_date").cast("date")
    val = F.col("val").cast("double")
    needed = facts.select("fact_id", "cik", "tag", "unit", "context_id", "val", "accession", "filed", "end_date", "origin")
    return spread(needed, "fact_id").select(
        cik_number("cik").alias("cik"), tag_key("tag").alias("tag"), unit_key("unit").alias("unit"), context_key("context_id").alias("context"),
        F.col("fact_id").cast("bigint").alias("fact_id"), F.col("origin").cast("string").alias("origin"),
        F.when(~F.isnan(val), val + F.lit(0.0)).alias("val"), accession_18(F.col("accession").cast("string")).alias("accession"),
        filed.alias("filed"), F.when(filed.isNull() | (end <= filed), end).alias("end_date"),
    ).where("cik is not null and tag is not null and unit is not null and context is not null and fact_id is not null")


def _trust(origins: DataFrame) -> DataFrame:
    """``origin, trust``: a name declared twice has the higher trust; a null trust is 0."""
    return origins.where("origin is not null").groupBy(F.col("origin").cast("string").alias("origin")).agg(F.max(F.coalesce(F.col("trust").cast("int"), F.lit(0))).alias("trust"))


def declared_sources(origins: DataFrame) -> tuple[tuple[str | None, ...], tuple[int, ...]]:
    """Names and trust of the declared origins, which are few beside the facts; the
    first stands for null and undeclared origins, trust 0."""
    rows = sorted(_trust(origins).collect(), key=lambda r: r["origin"])
    return (None, *[r["origin"] for r in rows]), (0, *[r["trust"] for r in rows])


def _words(sources: tuple[str | None, ...]) -> range:
    return range(-(-len(sources) // WORD))


def _bits(sources: tuple[str | None, ...]) -> list[Column]:
    """One bigint per word of the set that holds the row's source alone."""
    out = []
    for w in _words(sources):
        bit = F.when(F.lit(False), F.lit(0).cast("bigint"))
        for j, name in enumerate(sources[1:], 1):
            if j // WORD == w:
                bit = bit.when(F.col("origin") == name, F.lit(1 << j % WORD).cast("bigint"))
            else:
                bit = bit.when(F.col("origin") == name, F.lit(0).cast("bigint"))
        out.append(bit.otherwise(F.lit(1 if w == 0 else 0).cast("bigint")).alias(f"bit{w}"))
    return out


def _or(kind: str, words: range, of: str) -> list[Column]:
    return [F.bit_or(f"{of}{w}").alias(f"{kind}{w}") for w in words]


def claims(rows: DataFrame, sources: tuple[str | None, ...]) -> DataFrame:
    """``spot, value, mask0, ...``: of each stated value the sources that state it.

    ``spot`` is a 62-bit hash of the group with the field in its last two bits,
    ``value`` a 32-bit hash of the value: a chance collision only blurs the
    statistics the model is fitted to.
    """
    stated = [F.when(F.col(f).isNotNull(), F.struct(F.lit(i).cast("bigint").alias("field"), F.hash(f).alias("value"))) for i, f in enumerate(FIELDS)]
    group = F.shiftleft(F.xxhash64("cik", "tag", "unit", "context"), 2)
    bits = [f"bit{w}" for w in _words(sources)]
    return (
        rows.select(group.alias("g"), *_bits(sources), F.explode(F.array_compact(F.array(*stated))).alias("c"))
        .select(F.col("g").bitwiseOR(F.col("c.field")).alias("spot"), F.col("c.value").alias("value"), *bits)
        .groupBy("spot", "value").agg(*_or("mask", _words(sources), "bit"))
    )


def patterns(stated: DataFrame, words: range) -> DataFrame:
    """``field, cover0, ..., mask0, ..., n``: how many values show each pattern.

    A spot is first reduced to its distinct masks with their counts, of which
    there are no more than sets of sources.
    """
    masks, covers = [f"mask{w}" for w in words], [f"cover{w}" for w in words]
    return (
        stated.groupBy("spot", *masks).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("spot").agg(*_or("cover", words, "mask"), F.collect_list(F.struct(*masks, "n")).alias("masks"))
        .select(F.col("spot").bitwiseAND(F.lit(3)).cast("int").alias("field"), *covers, F.inline("masks"))
        .groupBy("field", *covers, *masks).agg(F.sum("n").alias("n"))
    )


#: Where the model starts from, and its weak Beta priors (most
#: statements are true, few false), which keep sources without evidence defined.
_START = (0.8, 0.9, 0.5)


class _Model:
    """Sensitivity, specificity and prior of truth per field, and one step of the fit."""

    def __init__(self, sources: int):
        k = len(FIELDS)
        self.se, self.sp, self.prior = np.full((k, sources), _START[0]), np.full((k, sources), _START[1]), np.full(k, _START[2])
        self.stated = np.zeros((k, sources))

    def expect(self, table: np.ndarray) -> np.ndarray:
        """Sums over rows (field, cover words, mask words, n) at the present
        parameters, additive over parts of the table: per field, for each source
        true and stated, true and covered, false and silent, false and covered,
        stated; then true and all."""
        s = self.se.shape[1]
        words = (table.shape[1] - 2) // 2
        sums = np.zeros((len(FIELDS), 5 * s + 2))
        at = np.arange(s)
        sets = lambda first: ((table[:, first + at // WORD] >> (at % WORD)) & 1).astype(float)
        state, cover = sets(1 + words), sets(1)
        silent, n = cover * (1 - state), table[:, -1].astype(float)
        for f in range(len(FIELDS)):
            own = table[:, 0] == f
            st, si, w = state[own], silent[own], n[own]
            yes = np.log(self.prior[f]) + st @ np.log(self.se[f]) + si @ np.log1p(-self.se[f])
            no = np.log1p(-self.prior[f]) + st @ np.log1p(-self.sp[f]) + si @ np.log(self.sp[f])
            p = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
            t, u = w * p, w * (1 - p)
            sums[f] = np.concatenate([t @ st, t @ (st + si), u @ si, u @ (st + si), w @ st, [t.sum(), w.sum()]])
        return sums

    def maximise(self, sums: np.ndarray) -> None:
        s = self.se.shape[1]
        has = sums[:, -1] > 0
        part = [sums[:, i * s : (i + 1) * s] for i in range(5)]
        self.se[has] = ((part[0] + 8) / (part[1] + 10))[has]
        self.sp[has] = ((part[2] + 9) / (part[3] + 10))[has]
        self.prior[has] = ((sums[:, -2] + 5) / (sums[:, -1] + 10))[has]
        self.stated = part[4]


def fit(histogram: list[tuple[int, int, int, int]], sources: tuple[str | None, ...], trust: tuple[int, ...], rounds: int = ROUNDS) -> SourceQuality:
    """Expectation-maximisation on a histogram of (field, cover, mask, n), sets
    of sources as whole numbers; an empty histogram returns the priors."""
    part = (1 << WORD) - 1
    split = lambda x: [x >> WORD * w & part for w in _words(sources)]
    table = np.array([[f, *split(c), *split(m), n] for f, c, m, n in histogram], np.int64).reshape(-1, 2 + 2 * len(_words(sources)))
    model = _Model(len(sources))
    for _ in range(rounds):
        model.maximise(model.expect(table))
    return SourceQuality(sources, trust, model.se, model.sp, model.prior, model.stated)


def fit_table(histogram: DataFrame, sources: tuple[str | None, ...], trust: tuple[int, ...], rounds: int = ROUNDS) -> SourceQuality:
    """The same on a table of ``patterns``: each round sums the parts of it where they lie."""
    kept, model = written(histogram, "patterns"), _Model(len(sources))
    width = 5 * len(sources) + 2
    for _ in range(rounds):

        def sums(batches, model=model):
            for batch in batches:
                got = model.expect(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(FIELDS)), width)), pa.array(np.tile(np.arange(width), len(FIELDS))), pa.array(got.ravel())], names=["field", "at", "x"])

        total = np.zeros((len(FIELDS), width))
        for r in kept.mapInArrow(sums, "field bigint, at bigint, x double").groupBy("field", "at").agg(F.sum("x").alias("x")).collect():  # fields x width
            total[r["field"], r["at"]] = r["x"]
        model.maximise(total)
    return SourceQuality(sources, trust, model.se, model.sp, model.prior, model.stated)


def _fitted(histogram: DataFrame, sources: tuple[str | None, ...], trust: tuple[int, ...]) -> SourceQuality:
    """The model fitted to a table of ``patterns``, on the driver where they are few."""
    words, found = _words(sources), written(histogram, "histogram")
    here = found.limit(HERE + 1).collect()
    whole = lambda r, kind: sum(r[f"{kind}{w}"] << WORD * w for w in words)
    q = fit_table(found, sources, trust) if len(here) > HERE else fit([(r["field"], whole(r, "cover"), whole(r, "mask"), r["n"]) for r in here], sources, trust)
    forget(found)
    return q


def learn(rows: DataFrame, origins: DataFrame) -> SourceQuality:
    """The quality of all sources from all rows."""
    sources, trust = declared_sources(origins)
    return _fitted(patterns(claims(rows, sources), _words(sources)), sources, trust)


def _order(trust: Column) -> Column:
    """The declared order as one number of fixed width: highest ``trust``, then the
    latest ``filed`` (null last), then the largest ``fact_id``."""
    rank = (trust.cast("bigint") + F.lit(1 << 31)).cast("string")  # ten digits at most
    days = F.coalesce(F.date_diff("filed", F.lit("0001-01-01").cast("date")) + 1, F.lit(0))
    high = F.col("fact_id").cast("decimal(19,0)") + F.expr("9223372036854775808BD")
    return F.concat(rank, F.lpad(days.cast("string"), 8, "0"), F.lpad(high.cast("string"), 20, "0")).cast("decimal(38,0)")


def picked(facts: DataFrame, origins: DataFrame) -> DataFrame:
    """``group_id`` and, of each field, the ``fact_id`` it is taken from (``val_id,
    accession_id, filed_id, end_id``; -1 where none is usable) with the posterior of
    the value stated there (``val_posterior, ...``; NULL where none is usable), of
    each group of two or more rows.

    Of the judged values of a field the one of the best row by declared order is
    taken, then the one most likely true. The order ends in ``fact_id``, so it is
    the order that decides. Choices are maxima that combine partially: a group that
    holds a third of all rows is never gathered.
    """
    best = F.struct("order", "posterior")
    picks = {"val_id": "val", "accession_id": "accession", "filed_id": "filed", "end_id": "end_date"}
    chosen = judged(facts, origins, text=False).groupBy("group_id", "g1").agg(*[F.max(F.when(F.col("field") == i, best)).alias(f) for i, f in enumerate(FIELDS)])
    back = lambda f: F.expr(f"cast({f}.order % 100000000000000000000 - 9223372036854775808 as bigint)")
    return chosen.select("group_id", *[c for o, f in picks.items() for c in (F.coalesce(back(f), F.lit(-1).cast("bigint")).alias(o), F.col(f"{f}.posterior").alias(f"{f}_posterior"))])


def best_sources(facts: DataFrame, origins: DataFrame) -> DataFrame:
    """``group_id, val_id, accession_id, filed_id, end_id`` of each group of two or
    more rows: the ``fact_id`` each field is taken from, -1 where none is usable.

    Sources come in the declared order: highest ``trust`` (0 for null and
    undeclared origins), then the latest ``filed`` (null last), then the largest
    ``fact_id``; see ``picked``.

    Rows without filer number, tag, unit, context or fact_id belong to no group;
    repeated rows count; an empty table has no groups.
    """
    return picked(facts, origins).select("group_id", "val_id", "accession_id", "filed_id", "end_id")


def source_quality(facts: DataFrame, origins: DataFrame) -> DataFrame:
    """``source, field, trust, stated, sensitivity, specificity``: the fitted model,
    one row per source and field; undeclared origins are source ``(other)``."""
    q = learn(prepared(facts), origins)
    rows = [
        (s or "(other)", f, q.trust[j], int(q.stated[i, j]), float(q.sensitivity[i, j]), float(q.specificity[i, j]))
        for i, f in enumerate(FIELDS) for j, s in enumerate(q.sources)
    ]
    return facts.sparkSession.createDataFrame(rows, "source string, field string, trust int, stated bigint, sensitivity double, specificity double")


def judged(facts: DataFrame, origins: DataFrame, text: bool = True) -> DataFrame:
    """``group_id, g1, field, value, posterior, order`` of every value stated in a
    group of two or more rows, ``field`` as its number; ``order`` is the place of the
    best row by declared order that states it. Rows that state nothing usable leave
    one row of their group with field NULL. ``g1`` tells groups apart that share a
    smallest ``fact_id``. ``value`` is its text, or 64 bits of hash if not ``text``.

    The model is fitted to these values and the groups of one row: the same
    patterns as ``learn`` counts, without another pass over the rows.
    """
    sources, declared = declared_sources(origins)
    words = _words(sources)
    # 128 bits stand for the group's four texts; groups of one row are only counted.
    group = [F.xxhash64("cik", "tag", "unit", "context").alias("g1"), F.xxhash64(F.lit(1), "context", "unit", "tag", "cik").alias("g2")]
    trust = F.when(F.lit(False), F.lit(0))
    for name, t in list(zip(sources, declared, strict=True))[1:]:
        trust = trust.when(F.col("origin") == name, F.lit(t))
    value = lambda f: (F.col(f).cast("string") if text else F.when(F.col(f).isNotNull(), F.xxhash64(f))).alias(f)
    keyed = prepared(facts).select(*group, "fact_id", *_bits(sources), _order(trust.otherwise(0)).alias("order"), *[value(f) for f in FIELDS])
    none = F.lit(0).cast("bigint")
    covers = [F.array(*[F.coalesce(F.bit_or(F.when(F.col(f).isNotNull(), F.col(f"bit{w}"))), none) for f in FIELDS]).alias(f"covers{w}") for w in words]
    groups = written(keyed.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("group_id"), *covers), "groups")
    cover = lambda i: [F.get(f"covers{w}", F.lit(i)).alias(f"cover{w}") for w in words]
    stated = [F.when(F.col(f).isNotNull(), F.struct(F.lit(i).alias("field"), F.col(f).alias("value"), *cover(i))) for i, f in enumerate(FIELDS)]
    found = written(
        keyed.join(groups.where("n > 1").drop("n"), ["g1", "g2"])
        .select("group_id", "g1", *[f"bit{w}" for w in words], "order", F.explode_outer(F.array_compact(F.array(*stated))).alias("c"))
        .groupBy("group_id", "g1", "c.field", "c.value", *[F.col(f"c.cover{w}") for w in words]).agg(*_or("mask", words, "bit"), F.max("order").alias("order")),
        "values",
    )
    sets = [f"{kind}{w}" for kind in ("cover", "mask") for w in words]
    alone = groups.where("n = 1").select(F.explode(F.array(*[F.struct(F.lit(i).alias("field"), *cover(i)) for i in range(len(FIELDS))])).alias("c"))
    alone = alone.select("c.*").where(" or ".join(f"cover{w} <> 0" for w in words)).select("field", *[f"cover{w}" for w in words], *[F.col(f"cover{w}").alias(f"mask{w}") for w in words])
    q = _fitted(found.where("field is not null").select("field", *sets).union(alone).groupBy("field", *sets).agg(F.count(F.lit(1)).alias("n")), sources, declared)
    forget(groups)
    odds = F.lit(0.0)
    for i in range(len(FIELDS)):
        side = F.lit(float(np.log(q.prior[i]) - np.log1p(-q.prior[i])))
        for j in range(len(q.sources)):
            has = lambda c, j=j: F.shiftright(F.col(f"{c}{j // WORD}"), j % WORD).bitwiseAND(F.lit(1)) == 1
            yes, no = float(q.weight()[i, j]), float(np.log1p(-q.sensitivity[i, j]) - np.log(q.specificity[i, j]))
            side = side + F.when(has("mask"), F.lit(yes)).when(has("cover"), F.lit(no)).otherwise(F.lit(0.0))
        odds = F.when(F.col("field") == i, side).otherwise(odds)
    return found.select("group_id", "g1", "field", "value", (1 / (1 + F.exp(-odds))).alias("posterior"), "order")


def true_values(facts: DataFrame, origins: DataFrame, least: float = 0.5) -> DataFrame:
    """``group_id, field, value, posterior`` of every value judged true in each
    group of two or more rows; a field may keep several, or none.

    Values are text: ``val`` as Spark writes a double, dates as yyyy-MM-dd.
    """
    names = F.array(*[F.lit(f) for f in FIELDS])
    return judged(facts, origins).where((F.col("posterior") >= least) & F.col("field").isNotNull()).select("group_id", F.get(names, F.col("field")).alias("field"), "value", "posterior")


def best_records(facts: DataFrame, origins: DataFrame) -> DataFrame:
    """``group_id`` and, of each field, the value most likely true with its
    posterior (``val, val_posterior, ...``): one surviving record for each group
    of two or more rows.

    Of equally likely values the one of the best row by trust, ``filed`` and
    ``fact_id`` survives; a field no row states is NULL. Values as in
    ``true_values``.
    """
    # Rounded, so that sums of logarithms in another order break no tie.
    best = F.struct(F.round("posterior", 9).alias("posterior"), "order", "value")
    picks = [F.max(F.when(F.col("field") == i, best)).alias(f) for i, f in enumerate(FIELDS)]
    out = [c for f in FIELDS for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.posterior").alias(f"{f}_posterior"))]
    return judged(facts, origins).where("field is not null").groupBy("group_id").agg(*picks).select("group_id", *out)
