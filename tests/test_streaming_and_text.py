"""Incremental loads, and small functions on columns."""

from pyspark.sql import functions as F

from ontoloom.functions import text
from ontoloom.operators import graph
from ontoloom.streaming.ingest import document_stream, merge_stream


def test_later_loads_replace_whole_ontologies(spark, tmp_path):
    schema = "ontology_id string, id string, load int"
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    for load, ids in enumerate(({"a": "12", "b": "123"}, {"b": "14", "c": "1"})):
        lines = [f'{{"ontology_id":"{o}","id":"{i}","load":{load}}}' for o, each in ids.items() for i in each]
        (folder / f"{load}.json").write_text("\n".join(lines))
        for _ in range(2):  # a second run finds nothing new
            assert merge_stream(document_stream(spark, str(folder), schema), table, str(tmp_path / "progress")).awaitTermination(60)
    got = {(r["ontology_id"], r["id"], r["load"]) for r in spark.read.schema(schema).parquet(table).collect()}
    assert got == {("a", "1", 0), ("a", "2", 0), ("b", "1", 1), ("b", "4", 1), ("c", "1", 1)}


def test_small_functions(spark):
    of = lambda values, f: [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]
    assert of(["http://x/2024-05-06/o.owl", "http://x/v3.1/o.owl", "http://x/o.owl", None], text.version_of) == ["2024-05-06", "v3.1", None, None]
    assert of(["http://x/o-1.owl?a=b"], text.cache_name) == ["http___x_o-1.owl_a_b"]
    assert of(["7", "1.50", "99999999999", "x", None], text.rendered_number) == ["7", "1.5", "9.9999999999E10", None, None]
    assert of(["b,a,c"], lambda c: text.first_text(F.split(c, ","))) == ["a"]
    nodes = spark.createDataFrame([("a", "class", 1), ("b", "class", 2)], "id string, type string, n int")
    assert [r["id"] for r in graph.nodes_where(nodes, type="class", n=2).collect()] == ["b"] and graph.nodes_where(nodes).count() == 2
