"""Unwrapping of nested documents against a plain recursion."""

import json

import pytest
from pyspark.errors import PySparkException

from ontoloom.operators import nested


def plain(value):
    if isinstance(value, dict):
        kinds = value.get("type")
        if not isinstance(kinds, list) or "datatype" in kinds and not set(kinds) & set(nested.WRAPPERS):
            return None
        assert set(kinds) & set(nested.WRAPPERS), "???"
        return plain(value.get("value"))
    return value


def plain_rows(docs):
    out = set()
    text = lambda v: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    for id_, doc in docs:
        for k, v in (doc if isinstance(doc, dict) else {}).items():
            v = plain(v)
            if isinstance(v, list):
                out |= {(id_, k.replace(":", "__"), i, text(plain(x))) for i, x in enumerate(v) if plain(x) is not None}
            elif v is not None:
                out.add((id_, k.replace(":", "__"), 0, text(v)))
    return out


LITERAL = {"type": ["literal"], "value": "v", "lang": "de"}
DOCS = [
    (1, {"a": "text", "http://x#p": ["x", LITERAL, {"type": ["reification"], "value": LITERAL, "axioms": [{"c": "why"}]}], "n": 5, "b": True, "none": None}),
    (2, {"expr": {"on": "p", "some": "C"}, "config": {"type": "x", "value": "y"}, "rel": {"type": ["related", "reification"], "value": {"type": ["literal"], "value": ["in", LITERAL]}}}),
    (3, {"dt": {"type": ["datatype"], "value": "int"}, "deep": [[1, "x"], {"type": ["literal"], "value": None}], "empty": [], "f": 1.5}),
    (4, []), (5, "text"), (6, {}),
]


def test_values_equal_a_plain_recursion(spark):
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in DOCS] + [(7, None)], "id int, doc string")
    got = [tuple(r) for r in nested.search_values(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_rows(DOCS)


def test_unknown_kinds_and_depths_are_errors(spark):
    ask = lambda d: nested.search_values(spark.createDataFrame([(1, json.dumps(d))], "id int, doc string")).collect()
    with pytest.raises(PySparkException):
        ask({"a": {"type": ["odd"], "value": "x"}})
    value = "x"
    for k in range(nested.DEPTH + 1):
        if k == nested.DEPTH:
            assert [r["value"] for r in ask({"a": value})] == ["x"]
        value = {"type": ["literal"], "value": value}
    with pytest.raises(PySparkException):
        ask({"a": value})
