"""Match modes of the search against a plain version that builds every token."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ontoloom.operators import search

PIECES = ["the", "The", "other", "thé", "ΑΒΓ", "x1", "1", "a.b", "a-b", "$5", "(c)", "_", "-", ".", " ", "  ", "\n", "ß", "日本", "\\E"]


def plain(value, text, how):
    if how == search.WHOLE:
        return value == text
    fold, spaced = how != search.TOKENS, how in (search.TOKENS, search.SPACE_TOKENS, search.SPACE_EDGES)
    value, text = (value.lower(), text.lower()) if fold else (value, text)
    cut = (lambda s: s.split()) if spaced else (lambda s: [w for w in re.split(r"[\W_]+", s) if w])
    have, wanted = cut(value), cut(text)
    begins = how in (search.EDGES, search.SPACE_EDGES)
    return bool(wanted) and all(any(t.startswith(w) if begins else t == w for t in have) for w in wanted)


@pytest.mark.parametrize("how", [search.WHOLE, search.TOKENS, search.LOWER_TOKENS, search.EDGES, search.SPACE_TOKENS, search.SPACE_EDGES])
def test_modes(spark, how):
    rnd = random.Random(5)
    values = ["".join(rnd.choice([p, p + " "]) for p in rnd.choices(PIECES, k=rnd.randrange(1, 7))) for _ in range(300)] + ["", "the"]
    df = spark.createDataFrame([(i, v, [v, "zzz"]) for i, v in enumerate(values)] + [(-1, None, None), (-2, None, [None])], "id int, one string, many array<string>").cache()
    for text in ("the", "The x1", "a.b", "1 $5", "ß", "日本", "(c)", "\\E", "_", " ", "αβγ th"):
        got = df.select("id", search.matches(df, "one", text, how).alias("a"), search.matches(df, "many", text, how).alias("b")).collect()
        want = {i: plain(v, text, how) for i, v in enumerate(values)}
        assert {r["id"]: r["a"] for r in got} == want | {-1: False, -2: False}
        assert {r["id"]: r["b"] for r in got if r["id"] >= 0} == want
        assert not any(r["b"] for r in got if r["id"] < 0)


def test_scores_once_and_pages(spark):
    df = spark.createDataFrame([(1, "heart"), (2, "heart valve"), (3, "lung"), (4, None)], "id int, label string")
    spec = search.SearchSpec("heart", fields=(("label", 2.0, search.SPACE_EDGES),), boosts=(("label", None, 5.0, search.WHOLE),))
    hits = search.search(df, spec)
    assert [(r["id"], r["score"]) for r in search.page(hits, 0, 10).collect()] == [(1, 7.0), (2, 2.0)]
    assert [r["id"] for r in search.page(hits, 1, 10).collect()] == [2]
    assert hits.columns == ["id", "label", "score"]
    assert search.search(df, search.SearchSpec()).agg(F.sum("score")).first()[0] == 4.0


def test_groups_expand_from_their_first_rows(spark):
    rows = [(i, f"g{i % 3}" if i % 5 else "hot", float(i % 7)) for i in range(200)] + [(900, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, score double")
    out = search.expanded(df, "g", 4)
    want = []
    for g in {r[1] for r in rows}:
        want += [(*r, k) for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:5])]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()  # cut before the shuffle


def test_page_and_total_in_one_job(spark):
    df = spark.createDataFrame([(i, f"word{i % 4}", float(i % 9)) for i in range(57)], "id int, label string, score double").repartition(5)
    spark.sparkContext.setJobGroup("one-page", "page and total")
    got = search.answered(df, 20, 10)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one-page")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = sorted(((r["score"], r["id"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))[20:30]
    assert [(e["score"], e["id"]) for e in got["elements"]] == want
    assert {k: got[k] for k in ("page", "numElements", "totalPages", "totalElements")} == {"page": 2, "numElements": 10, "totalPages": 6, "totalElements": 57}
    assert len(jobs) <= 2  # at most the shuffle's map stage beside the page itself
    nothing = search.answered(df.where("id < 0"), 0, 10)
    assert nothing == {"page": 0, "numElements": 0, "totalPages": 0, "totalElements": 0, "elements": []}
