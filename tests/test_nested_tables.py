import json

from tallyweir.operators.nested_tables import _parse_deep, fact_paths, flat_tables, parse_record

from .conftest import rows

GOOD = {
    "us-gaap": {
        "Assets": {"label": "A", "description": None, "units": {"USD": [{"end": "2020-12-31", "val": 1.5, "accn": "x", "prior_values": [None, {"val": 2}]}, None, {"val": "3"}]}, "meta": {"units": {"USD": [{}]}}},
        "Odd": {"units": {"USD": {"val": 9, "prior_values": {"val": 8}}, "EUR": None, "JPY": 5}},
        "None": {"units": None}, "Text": "x",
    },
    "srt": None,
}


def records(spark, texts):
    return spark.createDataFrame([(i, "7", "n", t, "clash") for i, t in enumerate(texts)], "record_id bigint, cik string, entityname string, facts string, tag string")


def test_paths(spark):
    got = rows(fact_paths(records(spark, [json.dumps(GOOD), None, "", "  ", "[1]", "null", json.dumps(GOOD) + "x", '{"a": NaN}', '{"a":'])))
    assert got == sorted([(0, "us-gaap", "Assets", "USD", 0, -1), (0, "us-gaap", "Assets", "USD", 0, 1), (0, "us-gaap", "Assets", "USD", 2, -1), (0, "us-gaap", "Odd", "USD", 0, -1), (0, "us-gaap", "Odd", "USD", 0, 0)])


def test_tables_link_to_their_parents(spark):
    t = flat_tables(records(spark, [json.dumps(GOOD, indent=1), "broken"]))
    assert rows(t["filers"]) == [(0, "7", "n"), (1, "7", "n")]
    assert rows(t["concepts"]) == [(0, "us-gaap", "Assets", "A", None), (0, "us-gaap", "None", None, None), (0, "us-gaap", "Odd", None, None)]
    assert rows(t["units"]) == [(0, "us-gaap", "Assets", "USD"), (0, "us-gaap", "Odd", "EUR"), (0, "us-gaap", "Odd", "JPY"), (0, "us-gaap", "Odd", "USD")]
    facts = {(r.tag, r.fact_pos): (r.end, r.val, r.accn) for r in t["facts"].collect()}
    assert facts == {("Assets", 0): ("2020-12-31", "1.5", "x"), ("Assets", 2): (None, "3", None), ("Odd", 0): (None, "9", None)}
    assert rows(t["priors"], "tag", "fact_pos", "prior_pos", "val") == [("Assets", 0, 1, "2"), ("Odd", 0, 0, "8")]
    assert t["facts"].join(t["units"], ["record_id", "taxonomy", "tag", "unit"], "left_anti").count() == 0


def test_no_record(spark):
    assert fact_paths(records(spark, []).limit(0)).count() == 0


def test_parser_edges():
    deep = "[" * 100_000 + "]" * 100_000
    assert parse_record(deep) is not None and parse_record(deep[:-1]) is None
    assert parse_record('{"a":1,"a":2}') == {"a": 2}
    for text in ('{"a":[1,{"b":null}],"c":"\\u00e9"}', "[]", "{}", ' {"x": -1.5e3 } '):
        assert _parse_deep(text) == json.loads(text)
    for text in ("{,}", "[1,]", '{"a" 1}', "[1}", "{]", "1 2", "", "[", '"a', "01", "{'a':1}", "[tru]", "]"):
        try:
            got = _parse_deep(text)
        except ValueError:
            continue
        raise AssertionError((text, got))


def test_lone_surrogate_does_not_break_arrow(spark):
    text = '{"t":{"\\ud800":{"units":{"u":[{}]}}}}'
    assert rows(fact_paths(records(spark, [text])), "tag") == [("�",)]


def test_numbers_keep_their_digits(spark):
    digits = "9" * 5000
    text = '{"t":{"a":{"units":{"u":[{"val":1.10,"fy":1e3,"form":12345678901234567.89,"accn":%s,"fp":true,"frame":{"x":[1.0,null]}}]}}}}' % digits
    r = flat_tables(records(spark, [text]), ("fact",))["facts"].first()
    assert (r.val, r.fy, r.form, r.accn, r.fp, r.frame) == ("1.10", "1e3", "12345678901234567.89", digits, "true", '{"x": [1.0, null]}')


def test_members_of_no_column_are_kept(spark):
    t = flat_tables(records(spark, [json.dumps(GOOD), '{"t":{"a":{"units":{"u":[{"val":1,"note":"n","more":[1, {"k": 2}]}]}}}}']))
    assert rows(t["members"], "record_id", "level", "tag", "fact_pos", "member", "value") == [
        (0, "concept", "Assets", -1, "meta", '{"units": {"USD": [{}]}}'), (1, "fact", "a", 0, "more", '[1, {"k": 2}]'), (1, "fact", "a", 0, "note", "n"),
    ]


def test_texts_of_one_id_do_not_mix(spark):
    one, two = '{"t":{"a":{"units":{"u":[{"val":1}]}}}}', '{"t":{"a":{"units":{"u":[{"end":"x"}]}}}}'
    df = spark.createDataFrame([(5, "7", "n", one), (5, "7", "n", one), (5, "7", "n", two)], "record_id bigint, cik string, entityname string, facts string")
    assert rows(flat_tables(df)["facts"], "val", "end") == [(None, "x"), ("1", None)]


def test_stream_agrees_with_whole_decoding():
    """Random records, damaged at random: the stream notes what a walk over the decoded value finds."""
    import random

    from tallyweir.operators.nested_tables import LEVELS, Number, _Stream

    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [None, True, -1.5e-3, 'q"\\u00e9', 12][kind]
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(["units", "prior_values", "val", "a", "b"]): value(depth - 1) for _ in range(rng.randrange(4))}

    def decoded(text):
        whole = _Stream(frozenset(LEVELS), True)
        try:
            root = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=lambda c: 1 / 0).decode(text)
        except (ValueError, ZeroDivisionError):
            return []
        if isinstance(root, dict):
            whole._take_value(root, 0, ())
        return sorted(whole.out, key=repr)

    seen = 0
    for _ in range(3000):
        text = json.dumps({"t": value(6), "u": {"x": {"units": value(4), "label": value(1)}}}, indent=rng.choice([None, 1]))
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", "}", "{", '"', "0", "[", ":"]) + text[at + 1 :]
        got = sorted(_Stream(frozenset(LEVELS), True).read(text), key=repr)
        assert got == decoded(text), text
        seen += bool(got)
    assert seen > 1000
