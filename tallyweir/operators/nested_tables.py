"""Deeply nested records into related flat tables.

Each record is read once, as a stream: objects are followed name by name, and the
elements of an array are decoded one at a time. What is read comes out as triples:
the path down to a value (taken apart at its repeated ancestors), the ordinals on
that path, and the value. A shape says where ancestors repeat: under names that are
data, such as taxonomies, or in arrays. Triples are grouped by repeated ancestor
and each group is pivoted into one table whose rows name their parent. The pivot is
a partial aggregation, so only one row per object is shuffled, and a record that
holds a third of all facts spreads over all tasks after the parse.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.session import fresh_path, spread

#: Members that make up each level, beside the repeated ones.
FACT_MEMBERS = ("start", "end", "val", "accn", "fy", "fp", "form", "filed", "frame")
PRIOR_MEMBERS = ("val", "filed", "accession")
CONCEPT_MEMBERS = ("label", "description")

LEVELS = ("concept", "unit", "fact", "prior")
TRIPLES = "record_id bigint, copy bigint, level string, taxonomy string, tag string, unit string, fact_pos bigint, prior_pos bigint, member string, value string"

#: The shape of company facts: a ``key`` step repeats under names that are data, an
#: ``items`` step in an array, a ``member`` step leads on. The n-th repeated step is
#: the n-th part of a path, and what stands there belongs to the n-th level.
SHAPE = (("key", "taxonomy"), ("key", "tag"), ("member", "units"), ("key", "unit"), ("items", "fact_pos"), ("member", "prior_values"), ("items", "prior_pos"))
_LEVEL_AT = (None, None, *LEVELS)
#: Rows in one Arrow batch that leaves the parser.
_BATCH = 20_000


def _refuse(token: str):
    raise ValueError(token)


class Number(str):
    """A number as it is written: no digit is lost, and none is too many."""

    __slots__ = ()


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_AS_WRITTEN = json.JSONDecoder(parse_constant=_refuse, parse_float=Number, parse_int=Number).scan_once
_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])|(true|false|null)(?!\w))'
)


def _parse_deep(text: str, number=json.loads):
    """The same as the decoder, with a stack of its own: no text is too deep."""
    pos, stack, root, number_of = 0, [], [], number
    expect, place = "value", root
    key = None

    def put(x):
        if isinstance(place, dict):
            place[key] = x
        else:
            place.append(x)

    while True:
        m = _TOKEN.match(text, pos)
        if m is None:
            if text[pos:].strip(" \t\n\r") or stack or expect != "end":
                raise ValueError("not JSON")
            return root[0]
        pos = m.end()
        mark, string, number, word = m.groups()
        if expect in ("value", "first") and mark in ("{", "["):
            new = {} if mark == "{" else []
            put(new)
            stack.append((place, key))
            place, expect = new, "key1" if mark == "{" else "first"
        elif (mark == "}" and isinstance(place, dict) and expect in ("key1", "next")) or (
            mark == "]" and isinstance(place, list) and stack and expect in ("first", "next")
        ):
            place, key = stack.pop()
            expect = "next" if stack else "end"
        elif expect in ("value", "first") and mark is None:
            put(json.loads(string) if string else {"true": True, "false": False, "null": None}[word] if word else number_of(number))
            expect = "next" if stack else "end"
        elif expect in ("key1", "key") and string:
            key, expect = json.loads(string), "colon"
        elif expect == "colon" and mark == ":":
            expect = "value"
        elif expect == "next" and mark == ",":
            expect = "key" if isinstance(place, dict) else "value"
        else:
            raise ValueError("not JSON")


def parse_record(text: str | None):
    """The value of a text that is well-formed JSON as a whole; else None.

    Names are kept as written; of members that repeat a name the last counts.
    """
    if not text:
        return None
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip(" \t\n\r")))
        return None if text[end:].strip(" \t\n\r") else value
    except RecursionError:
        try:
            return _parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def _dump(x) -> str:
    """JSON of a decoded value, with numbers as they were written."""
    if isinstance(x, Number):
        return x
    if isinstance(x, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_dump(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ", ".join(map(_dump, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def _scalar(x) -> str | None:
    if x is None or isinstance(x, str):
        return x
    try:
        return _dump(x)
    except RecursionError:
        return None


_BLANKS = re.compile(r"[ \t\n\r]*")


class _Stream:
    """Reads one text from front to back and notes the triples of the levels asked for.

    A text can prove not to be JSON at its very end, so triples count only when
    ``read`` has returned. Of members that repeat a name the last counts: what an
    earlier one left is struck out.
    """

    def __init__(self, levels: frozenset[str], members: bool):
        self.levels, self.members, self.out = levels, members, []

    def read(self, text: str | None) -> list[tuple]:
        self.out, self.text = [], text or ""
        try:
            end = self._take(self._skip(0), 0, ())
            if self._skip(end) != len(self.text):
                return []
        except (ValueError, StopIteration, IndexError):
            return []
        except RecursionError:
            self.out = []
            try:
                self._take_value(_parse_deep(self.text, Number), 0, ())
            except ValueError:
                return []
        return [t for t in self.out if t is not None]

    def _skip(self, at: int) -> int:
        return _BLANKS.match(self.text, at).end()

    def _named(self, at: int):
        """(name, where its value begins) of each member of the object at ``at``;
        the end of the value is sent back, and the end of the object comes last."""
        text = self.text
        at = self._skip(at + 1)
        if text[at] == "}":
            yield None, at + 1
            return
        while True:
            if text[at] != '"':
                raise ValueError("no name")
            name, at = json.decoder.scanstring(text, at + 1, True)
            at = self._skip(at)
            if text[at] != ":":
                raise ValueError("no colon")
            at = self._skip((yield name, self._skip(at + 1)))
            if text[at] == "}":
                yield None, at + 1
                return
            if text[at] != ",":
                raise ValueError("no comma")
            at = self._skip(at + 1)

    def _follow(self, at: int, inside) -> int:
        """Through the object at ``at``: ``inside(name, at)`` reads a value and returns its end."""
        noted: dict[str, tuple[int, int]] = {}
        walk = self._named(at)
        name, at = next(walk)
        while name is not None:
            a, b = noted.get(name, (0, 0))
            self.out[a:b] = [None] * (b - a)
            a = len(self.out)
            end = inside(name, at)
            noted[name] = (a, len(self.out))
            name, at = walk.send(end)
        return at

    def _take(self, at: int, s: int, path: tuple) -> int:
        """The value at ``at`` that step ``s`` applies to; returns its end."""
        kind, mark = SHAPE[s][0], self.text[at]
        if kind == "key" and mark == "{":
            return self._follow(at, lambda name, at: self._enter(at, s + 1, (*path, name)))
        if kind == "items" and mark == "[":
            at, i = self._skip(at + 1), 0
            if self.text[at] == "]":
                return at + 1
            while True:
                value, at = _AS_WRITTEN(self.text, at)
                self._enter_value(value, s + 1, (*path, i))
                at, i = self._skip(at), i + 1
                if self.text[at] == "]":
                    return at + 1
                if self.text[at] != ",":
                    raise ValueError("no comma")
                at = self._skip(at + 1)
        value, at = _AS_WRITTEN(self.text, at)
        self._take_value(value, s, path)
        return at

    def _enter(self, at: int, s: int, path: tuple) -> int:
        """The value at ``at`` that a name on the path leads to; returns its end."""
        kind = SHAPE[s][0]
        if kind == "member" and self.text[at] == "{":
            self._note(path, None, None)

            def inside(name: str, at: int) -> int:
                if name == SHAPE[s][1]:
                    return self._take(at, s + 1, path)
                value, at = _AS_WRITTEN(self.text, at)
                self._note(path, name, value)
                return at

            return self._follow(at, inside)
        if kind == "member":
            value, at = _AS_WRITTEN(self.text, at)
            return at
        if kind == "items":
            self._note(path, None, None)
        return self._take(at, s, path)

    def _take_value(self, value, s: int, path: tuple) -> None:
        """The same as ``_take`` for a value that is decoded already. An object in
        place of an array is its only element."""
        if SHAPE[s][0] == "key":
            for name, x in value.items() if isinstance(value, dict) else ():
                self._enter_value(x, s + 1, (*path, name))
        else:
            for i, x in enumerate(value if isinstance(value, list) else [value]):
                self._enter_value(x, s + 1, (*path, i))

    def _enter_value(self, value, s: int, path: tuple) -> None:
        kind, leads = SHAPE[s] if s < len(SHAPE) else ("member", None)
        if kind != "member":
            if kind == "items":
                self._note(path, None, None)
            self._take_value(value, s, path)
        elif isinstance(value, dict):
            self._note(path, None, None)
            for name, x in value.items():
                if name == leads:
                    self._take_value(x, s + 1, path)
                else:
                    self._note(path, name, x)

    def _note(self, path: tuple, member: str | None, value) -> None:
        level = _LEVEL_AT[len(path)]
        if level in self.levels and (member is None or self.members):
            names = (*path[:3], None, None)[:3]
            self.out.append((level, *names, *(*path[3:], -1, -1)[:2], member, _scalar(value)))


def triples_of(text: str | None, levels: frozenset[str], members: bool) -> Iterator[tuple]:
    """Triples of one record, in document order: for each object one that says it
    exists (member None) and, if asked for, one per member that leads to no other level."""
    return iter(_Stream(levels, members).read(text))


_ARROW = pa.schema(
    [("record_id", pa.int64()), ("copy", pa.int64()), ("level", pa.string()), ("taxonomy", pa.string()), ("tag", pa.string()), ("unit", pa.string())]
    + [("fact_pos", pa.int64()), ("prior_pos", pa.int64()), ("member", pa.string()), ("value", pa.string())]
)


def _text(x: str | None) -> str | None:
    """Lone surrogates, which JSON can escape but UTF-8 can't hold, become U+FFFD."""
    if x is None or x.isascii():
        return x
    return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _table(ids: list, copies: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 8
    texts = [[_text(x) for x in cols[k]] if k in (1, 2, 3, 6, 7) else cols[k] for k in range(8)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, copies, *texts], _ARROW.types, strict=True)], schema=_ARROW)


def triples(records: DataFrame, record_id: str = "record_id", text: str = "facts", levels: tuple[str, ...] = LEVELS, members: bool = True) -> DataFrame:
    """Path–value–ordinal triples of ``records``; only ``record_id`` and ``text``
    are read. Records without id, and texts that are null, empty or not
    well-formed as a whole, hold no triple. ``copy`` tells apart the texts of an id."""
    wanted = frozenset(levels)

    def parse(batches):
        stream = _Stream(wanted, members)
        for batch in batches:
            ids, copies, rows = [], [], []
            texts = batch.column(2)
            for k, (record, copy) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = stream.read(texts[k].as_py())
                for a in range(0, len(found), _BATCH):
                    part = found[a : a + _BATCH]
                    rows += part
                    ids += [record] * len(part)
                    copies += [copy] * len(part)
                    if len(rows) >= _BATCH:
                        yield _table(ids, copies, rows)
                        ids, copies, rows = [], [], []
            if rows:
                yield _table(ids, copies, rows)

    body = F.col(text).cast("string")
    plain = records.select(F.col(record_id).cast("bigint").alias("record_id"), F.xxhash64(body).alias("copy"), body.alias("text")).where("record_id is not null and text is not null")
    return spread(plain, "record_id").mapInArrow(parse, TRIPLES)


_PATHS = {
    level: ["record_id", *[name for kind, name in SHAPE if kind != "member"][: _LEVEL_AT.index(level)]] for level in LEVELS
}
_MEMBERS = {"concept": CONCEPT_MEMBERS, "unit": (), "fact": FACT_MEMBERS, "prior": PRIOR_MEMBERS}


def pivot_level(rows: DataFrame, level: str) -> DataFrame:
    """The flat table of one repeated ancestor: its path, and a column per member.

    The path without its last part is the path of the parent's row.
    """
    picks = [F.max(F.when(F.col("member") == m, F.col("value"))).alias(m) for m in _MEMBERS[level]]
    keys = [*_PATHS[level], "copy"]
    own = rows.where(F.col("level") == level)
    return (own.groupBy(*keys).agg(*picks) if picks else own.select(*keys).distinct()).drop("copy")


def flat_tables(records: DataFrame, levels: tuple[str, ...] = LEVELS) -> dict[str, DataFrame]:
    """``filers`` and, of the levels asked for, ``concepts, units, facts, priors`` of
    company-facts records, and ``members``.

    Filers come from the columns beside the text, one row per record, also where
    the text is unreadable. Members are text as written in the JSON, numbers with
    every digit; a missing and a null member are both NULL. ``members`` are those
    of an object that are no column of its table, with the path of the object.
    A row that repeats an id and its text adds nothing; another text of an id
    keeps rows of its own.
    """
    kept = triples(records, levels=levels)
    if len(levels) > 1:  # each record is parsed once
        path = fresh_path(records.sparkSession, "triples")
        kept.write.partitionBy("level").parquet(path)
        kept = records.sparkSession.read.schema(TRIPLES).parquet(path)
    column = F.lit(False)
    for level in levels:
        column = column | ((F.col("level") == level) & F.col("member").isin(*_MEMBERS[level]))
    return {
        "filers": records.select(F.col("record_id").cast("bigint").alias("record_id"), "cik", "entityname"),
        **{f"{level}s": pivot_level(kept, level) for level in levels},
        "members": kept.where(F.col("member").isNotNull() & ~column).drop("copy"),
    }


def fact_paths(records: DataFrame) -> DataFrame:
    """The rows of the tables of facts (``prior_pos`` -1) and prior values, by their paths."""
    tables = flat_tables(records, ("fact", "prior"))
    facts = tables["facts"].select(*_PATHS["fact"], F.lit(-1).cast("bigint").alias("prior_pos"))
    return facts.unionByName(tables["priors"].select(*_PATHS["prior"]))
