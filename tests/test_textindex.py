"""Searches by postings against searches that look at every row, and against plain scoring."""

import random
from dataclasses import replace

import pytest

from ontoloom.operators import search, textindex
from ontoloom.operators.search import BEST, EDGES, EVERY, HELD, LOWER_TOKENS, PHRASE, SPACE_EDGES, SPACE_TOKENS, SUM, TOKENS, WHOLE, SearchSpec
from ontoloom.service import Service, indexed_fields
from tests.test_search import PIECES, plain

MODES = [WHOLE, TOKENS, LOWER_TOKENS, EDGES, SPACE_TOKENS, SPACE_EDGES, PHRASE]
SCHEMA = "id string, label string, synonym array<string>, ontologyId string, flag boolean"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    text = lambda: "".join(rnd.choice([p, p + " "]) for p in rnd.choices(PIECES, k=rnd.randrange(1, 7)))
    rows = [(f"d{i}", text(), [text() for _ in range(rnd.randrange(3))], rnd.choice("ab"), rnd.random() < 0.5) for i in range(250)]
    rows += [("none", None, None, None, None), ("nulls", None, [None, "the x1"], "a", True), ("empty", "", [""], "b", False), ("long", "the " * 9 + "x1", [], "a", True), ("same", "the x1", ["the x1"] * 3, "a", None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    kinds = (textindex.WORD, textindex.SPACE, textindex.CASE, textindex.VALUE)
    return textindex.write(docs, {"label": kinds, "synonym": kinds, "absent": kinds}, str(tmp_path_factory.mktemp("index") / "rows"))


def same(index, docs, spec):
    by_row = {r["id"]: r["score"] for r in search.search(docs, spec).collect()}
    out = index.search(docs, spec)
    assert out.columns == [*docs.columns, "score"]
    by_index = [(r["id"], r["score"]) for r in out.collect()]
    assert len(by_index) == len({i for i, _ in by_index}) and dict(by_index) == by_row, spec
    return by_row


@pytest.mark.parametrize("how", MODES)
def test_every_mode_equals_the_scan(index, docs, how):
    found = 0
    for text in ("The x1", "1 $5", "\\E", "αβγ th", "the the x1", "the " * 9 + "x1", "o"):
        spec = SearchSpec(text, fields=(("label", 2.0, how), ("synonym", 3.0, how)), boosts=(("label", None, 5.0, PHRASE), ("ontologyId", "a", 7.0, WHOLE), ("synonym", None, 11.0, how)))
        found += len(same(index, docs, spec))
    assert found


@pytest.mark.parametrize("combine", [EVERY, HELD, SUM])
def test_every_combination_equals_the_scan(index, docs, combine):
    for text in ("the", "The x1", "th x", "日本 the"):
        for a, b in ((LOWER_TOKENS, SPACE_EDGES), (PHRASE, WHOLE)):
            same(index, docs, SearchSpec(text, fields=(("label", 2.0, a), ("synonym", 3.0, b)), boosts=(("label", None, 5.0, PHRASE), ("ontologyId", "a", 7.0, WHOLE)), filters={"ontologyId": ["a"]} if combine == SUM else {}, combine=combine))


def test_scores_against_plain_scoring(docs):
    """Every word somewhere, its greatest weight, and phrases: from the token lists of all values."""
    rows = docs.collect()
    fields, boosts = (("label", 5.0, LOWER_TOKENS), ("synonym", 3.0, SPACE_EDGES)), (("label", None, 10.0, PHRASE),)
    values = lambda r, n: [v for v in ([r[n]] if n == "label" else r[n] or []) if v is not None]
    cut = lambda s: [w for w in "".join(c.lower() if c.isalnum() else " " for c in s).split()]

    def phrase(r, text):
        want = cut(text)
        return any(have[i : i + len(want)] == want for v in values(r, "label") for have in [cut(v)] for i in range(len(have)))

    for text in ("the x1", "x1 a.b", "the - x1", "other", "a-b th"):
        want = {}
        for r in rows:
            words = [w for w in text.split() if cut(w) or any(h == SPACE_EDGES for _, _, h in fields)]
            best = [max((w for n, w, how in fields if any(plain(v, word, how) for v in values(r, n))), default=0) for word in words]
            if best and all(best):
                want[r["id"]] = sum(best) + (10.0 if phrase(r, text) else 0.0)
        got = {r["id"]: r["score"] for r in search.search(docs, SearchSpec(text, fields=fields, boosts=boosts, combine=EVERY)).collect()}
        assert got == want


def test_reads_only_folders_of_its_tokens(index, docs):
    one = SearchSpec("other", fields=(("label", 1.0, LOWER_TOKENS),))
    plan = index.hits(one)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "bucket" in scan[: scan.index("]")] and "token" in scan[scan.index("PushedFilters") :][:400]
    files = {r["bucket"] for r in index.rows.select("bucket").distinct().collect()}
    read = index.hits(one)._jdf.queryExecution().executedPlan()
    assert len(files) > 5 and read is not None
    touched = {r["bucket"] for r in index.rows.where("kind = 'word' and token = 'other'").select("bucket").distinct().collect()}
    assert len(touched) == 1
    begins = SearchSpec("oth", fields=(("label", 1.0, EDGES),))  # as many signs as choose a folder
    plan = index.hits(begins)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "StartsWith(token" in plan
    assert not index.reads(SearchSpec("x", fields=(("ontologyId", 1.0, WHOLE),)))  # falls back to the rows
    same(index, docs, SearchSpec("a", fields=(("ontologyId", 1.0, WHOLE),)))
    same(index, docs, SearchSpec(None, filters={"ontologyId": ["b"]}))
    same(index, docs, SearchSpec(" - ", fields=(("label", 1.0, LOWER_TOKENS),)))


def test_service_answers_alike_with_an_index(spark, tmp_path):
    rows = [
        ("o+class+1", "http://x/1", "o", ["class", "entity"], ["heart valve"], ["Cardiac Valve"], "X_1", "X:1", False, True, False, False, True),
        ("o+class+2", "http://x/2", "o", ["class", "entity"], ["valve of heart"], ["valve"], "X_2", "X:2", False, False, False, True, False),
        ("p+class+1", "http://x/1", "p", ["class", "entity"], ["Heart Valve"], [], "X_1", "X:1", False, False, True, False, False),
        ("p+class+3", "http://x/3", "p", ["class", "entity"], ["lung"], ["heartless organ"], "X_3", "X:3", True, True, False, False, False),
    ]
    schema = "id string, iri string, ontologyId string, type array<string>, label array<string>, synonym array<string>, shortForm string, curie string, isObsolete boolean, isDefiningOntology boolean, imported boolean, hasDirectChildren boolean, hasHierarchicalChildren boolean"
    docs = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([], "src string, edge_type string, dst string")
    plain_, quick = Service(docs, edges), Service(docs, edges, textindex.write(docs, indexed_fields(), str(tmp_path / "i")))
    scored = lambda a: sorted((r["id"], r["score"]) for r in a.hits.select("id", "score").collect())
    for ask in (
        lambda s: s.search("heart"), lambda s: s.search("valve heart", exact=True), lambda s: s.search("Heart valve", exact=True, ontologies=["o"]), lambda s: s.search("heart valve", exact=True, fields="label,synonym,short_form"),
        lambda s: s.search("heart", group=True), lambda s: s.select("heart va"), lambda s: s.select(""), lambda s: s.entities(text="heart"), lambda s: s.entities("class", text="valve", exact=True), lambda s: s.search("*"),
        lambda s: s.entities(text="X_1", label=["valve"]),
    ):
        assert scored(ask(plain_)) == scored(ask(quick))
    # legacy exact search: words in any order and case, the phrase and the defining ontology raise
    assert scored(quick.search("heart VALVE", exact=True)) == [("o+class+1", 120.0), ("o+class+2", 10.0), ("p+class+1", 20.0)]
    assert scored(quick.search("heart valve", exact=True, fields="label,synonym")) == [("o+class+1", 1.0), ("p+class+1", 1.0)]
    marks = {r["id"]: (r["label_autosuggest"], r["label_marked"]) for r in quick.select("heart").hits.collect()}
    assert marks["o+class+1"] == (["<b>heart</b> valve"], ["<b>heart</b> valve"]) and marks["p+class+1"] == (["<b>Heart</b> Valve"], ["Heart Valve"])
    # a filter holds where its tokens stand in a row
    assert [r["id"] for r in quick.entities("class", label=["VALVE"]).hits.orderBy("id").collect()] == ["o+class+1", "o+class+2", "p+class+1"]
    assert [r["id"] for r in quick.entities("class", label=["heart valve"], synonym=["cardiac,lung"]).hits.collect()] == ["o+class+1"]


def test_a_token_is_a_row_for_a_run_of_documents_and_texts_are_cut_once(spark, tmp_path):
    """postings travel in lists, from one pass over the texts; runs of any length give the same answers, and nulls and long texts are kept."""
    rows = [(i, "of the " * (i % 3) + f"w{i} the", [f"v{i}", None, "the of"]) for i in range(40)] + [(None, "of the", ["x"]), (90, None, None), (91, "", [""]), (92, "of " * 70 + "the", [])]
    docs = spark.createDataFrame(rows, "id int, label string, synonym array<string>")
    fields = {"label": (textindex.WORD, textindex.VALUE), "synonym": (textindex.WORD,)}
    plan = textindex.postings(docs, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2  # the texts' tokens are not rows
    want = {}
    for i, label, synonym in rows:
        for field, kind, values in (("label", "word", [label]), ("label", "value", [label]), ("synonym", "word", synonym or [])):
            for no, v in enumerate(values):
                for place, token in enumerate([] if v is None else [v] if kind == "value" else v.split(" ")):
                    if token or kind == "value":
                        want.setdefault((kind, field, no, token), []).append((i, place))
    # a text of 70 words, and 70 words wanted in a row, are more than a mask holds and more than a run of 16
    asked = [SearchSpec(t, fields=(("label", 2.0, LOWER_TOKENS), ("synonym", 3.0, PHRASE)), boosts=(("label", None, 5.0, PHRASE),)) for t in ("of the", "the of", "of " * 70 + "the", "of " * 71 + "the")]
    for size in (1, 16, 1 << 20):
        index = textindex.write(docs, fields, str(tmp_path / f"i{size}"), block=size)
        got = index.rows.collect()
        pairs = [((r["kind"], r["field"], r["value_no"], r["token"]), p) for r in got for p in zip(r["ids"], r["places"], strict=True)]
        by_key = {}
        for k, p in pairs:
            by_key.setdefault(k, []).append(p)
        order = lambda ps: sorted(ps, key=str)
        assert {k: order(ps) for k, ps in by_key.items()} == {k: order(ps) for k, ps in want.items()}
        for spec in asked:
            found = {r["id"]: r["score"] for r in index.search(docs, spec).collect()}
            assert found == {r["id"]: r["score"] for r in search.search(docs.where("id is not null"), spec).collect()}
    assert len(got) < len(pairs) / 2


def test_matches_combine_without_lists_and_a_frequent_token_is_dealt_out(spark, tmp_path):
    """what a search counts is a few numbers a document; a token that all runs hold is written by several tasks."""
    docs = spark.createDataFrame([(i, f"the w{i % 7}", "src3 x" if i % 3 else "The") for i in range(300)], "id int, text string, source string")
    spec = SearchSpec("The SRC3", fields=(("text", 5.0, LOWER_TOKENS), ("source", 3.0, LOWER_TOKENS)), combine=EVERY)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        index = textindex.write(docs, textindex.kinds_for(spec), str(tmp_path / "i"), block=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "ObjectHashAggregate" not in index.hits(spec)._jdf.queryExecution().executedPlan().toString()
    the = index.rows.where("token = 'the' and field = 'text'").selectExpr("size(ids) as n", "pmod(xxhash64(ids[0]), 4) as part").collect()
    assert sum(r["n"] for r in the) == 300 and max(r["n"] for r in the) <= 8 and len({r["part"] for r in the}) == 4
    assert {r["id"]: r["score"] for r in index.search(docs, spec).collect()} == {i: 8.0 for i in range(300) if i % 3}


def test_places_are_kept_only_where_phrases_are_asked(spark, tmp_path):
    """an index for searches without phrases has a document once for a value's word and no places; its answers are those of the scan."""
    docs = spark.createDataFrame([(i, "of the of x1 of", ["the the", None, f"the w{i}", ""]) for i in range(20)] + [(90, None, None), (91, "", []), (92, "OF of " * 40, ["oft"])], "id int, label string, synonym array<string>")
    fields = (("label", 2.0, LOWER_TOKENS), ("synonym", 3.0, EDGES))
    asked = [SearchSpec(t, fields=fields, combine=c) for t in ("of the", "of", "X1 w", "the w3", "zz") for c in (EVERY, HELD, SUM, BEST)]
    kinds = textindex.kinds_for(*asked)
    assert kinds == {"label": (textindex.BARE,), "synonym": (textindex.BARE,)}
    want = {("label", 0, t): list(range(20)) for t in ("of", "the", "x1")} | {("synonym", n, "the"): list(range(20)) for n in (0, 2)} | {("synonym", 2, f"w{i}"): [i] for i in range(20)} | {("synonym", 0, "oft"): [92]}
    want["label", 0, "of"] = [*range(20), 92]
    for size in (1, 16, 1 << 20):
        index = textindex.write(docs, kinds, str(tmp_path / f"i{size}"), block=size)
        got = {}
        for r in index.rows.collect():
            assert r["kind"] == textindex.BARE and r["places"] == []
            got.setdefault((r["field"], r["value_no"], r["token"]), []).extend(r["ids"])
        assert {k: sorted(ids) for k, ids in got.items()} == want
        assert sum(len(same(index, docs, spec)) for spec in asked) > 100
    # a phrase is not answered without places; where one is asked of a field, its words have them, and others read these too
    phrase = SearchSpec("of x1", fields=fields, boosts=(("label", None, 5.0, PHRASE),))
    assert not index.reads(phrase) and same(index, docs, phrase)
    both = textindex.kinds_for(*asked, phrase)
    assert both == {"label": (textindex.WORD,), "synonym": (textindex.BARE,)}
    mixed = textindex.write(docs, both, str(tmp_path / "mixed"), block=16)
    assert mixed.reads(phrase) and all(len(r["places"]) == (len(r["ids"]) if r["field"] == "label" else 0) for r in mixed.rows.collect())
    for spec in [phrase, *asked[:4]]:
        same(mixed, docs, spec)
