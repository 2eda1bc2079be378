"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

import corpus_pipeline
from ontoloom.llm import exact, langid, simhash, winnow
from tests.llm.edge import empty, frame, rows
from tests.llm.test_duplicates import plain_components
from tests.llm.test_scans import plain_contamination
from tests.llm.test_tokens import check_packing


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns = docs.columns
    # two documents without a letter, and one that repeats another's text
    odd = spark.createDataFrame([(900_001, "123 456 !!", None, "x", 10), (900_002, None, None, "x", 0)], docs.schema)
    docs = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, small)
        if name == "pack":
            check_packing(out.collect(), rows)
            break
        assert out.columns == columns
        out.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        kept = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language_id":
            want = [i for i, t in rows if i < 900_000 and any(map(str.isalpha, t or ""))]
        elif name == "exact_dedup":
            want = list({t or "": i for i, t in sorted(rows)}.values())
        elif name == "near_dedup":
            want = [i for i, _, least in plain_components(rows) if i == least]
        else:
            want = [k[0] for k in plain_contamination(rows, items) if not k[-1]]
        assert kept == sorted(want), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_stages_judge_rows_that_share_an_id_apart(spark):
    """Null and repeated ids: a rejected row takes no other row along, and of near copies without ids one stays."""
    words = [f"word{i}" for i in range(400)]
    near, other, item = " ".join(words), "quite another sort of text about the sea and ships", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = [(None, near), (None, near + " end"), (None, other), (7, "123 456"), (7, item), (7, "a clean text of plain words"), (None, "!!"), (8, other + " x"), (8, other + " x")]
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    learn = spark.createDataFrame([(i, t, "en") for i in range(100, 120) for _, t in docs if any(map(str.isalpha, t))], df.schema)
    known = {(r["doc_id"], r["text"]) for r in langid.keep_known_language(df.union(learn)).where("doc_id is null or doc_id < 100").collect()}
    assert known == {d for d in docs if d[1] not in ("123 456", "!!")}
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()]
    assert len(kept) == len(set(kept)) and {k for k, t in kept} == {None, 7, 8} and (None, other) in kept
    bits = bin(int(simhash.fingerprint_batch([near.encode()]).view("u8")[0]) ^ int(simhash.fingerprint_batch([(near + " end").encode()]).view("u8")[0])).count("1")
    assert bits <= 3 and sum(t.startswith(near) for _, t in kept) == 1
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    clean = sorted((str(r["doc_id"]), r["text"]) for r in winnow.drop_contaminated(df, bench).collect())
    assert clean == sorted((str(i), t) for i, t in docs if t != item)


def test_stages_take_odd_rows_and_empty_tables(spark, small):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing columns; and no rows at all."""
    have = {(r[0], r[1]) for r in rows()}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (frame(spark), empty(spark)):
            out = stage(spark, docs, small)
            got = out.collect()
            if name != "pack":
                assert out.columns == docs.columns, name
                assert {(r["doc_id"], r["text"]) for r in got} <= have
            if docs.isEmpty():
                assert not got, name
    exact = [(r["doc_id"], r["text"]) for r in corpus_pipeline.exact_dedup(spark, frame(spark), small).collect()]
    assert len({t or "" for _, t in exact}) == len(exact) == len({t or "" for _, t in have})


def test_stages_take_columns_without_order(spark):
    """Map, array and struct columns pass every stage, also where whole rows repeat."""
    docs = spark.sql("""
        select doc_id, text, 'en' as lang, 's' as source, 1L as n_chars, map('k', doc_id) as m, array(map(1, 2)) as a, named_struct('m', map('x', text)) as s
        from (select explode(array(1L, 1L, 2L, 3L, null, null)) as doc_id, 'the same plain words stand in this short text again' as text
              union all select 9L, 'another text of some words that is like no other one' union all select 9L, null union all select 9L, null)""")
    for stage in (exact.drop_exact_duplicates, simhash.drop_near_duplicates, lambda d: winnow.drop_contaminated(d, spark.createDataFrame([], "item_id long, text string"))):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.where("doc_id = 9 and text is not null").first()["s"]["m"] == {"x": "another text of some words that is like no other one"}
    assert sorted(str(r["doc_id"]) for r in exact.drop_exact_duplicates(docs).collect()) == ["3", "9", "9"]
    assert simhash.drop_near_duplicates(docs).count() == 3
