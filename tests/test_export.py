"""Node and edge files of the property graph."""

from ontoloom.functions import vocabulary as V
from ontoloom.operators import export

PROPS = "ontology_id string, id string, predicate string, pos int, kind string, value string, datatype string, lang string"


def test_node_file(spark, tmp_path):
    rows = [
        ("o", "a", V.LABEL, 0, "literal", "x|y", "", "en"), ("o", "a", V.LABEL, 1, "literal", "zwei", "", "de"), ("o", "a", V.LABEL, 2, "literal", 'q"t', "", ""), ("o", "a", V.LABEL, 3, "literal", "drei", "", "de"),
        ("o", "a", "p", 0, "bnode", "_:1", None, None), ("o", "a", "appearsIn", 0, "literal", "o", "", ""), ("o", "r", "only", 0, "uri", "a", None, None), ("o", "a", "p", 1, "literal", None, None, None),
    ]
    props = spark.createDataFrame(rows, PROPS)
    kinds = spark.createDataFrame([("o", "a", "class"), ("o", "b", "class"), ("o", "r", "property")], "ontology_id string, id string, type string")
    rendered = spark.createDataFrame([("o", "a", "{}")], "ontology_id string, id string, json string")
    out = export.graph_nodes(props, kinds, rendered, "class")
    name = V.LABEL.replace(":", "__")
    assert out.columns == ["id:ID", ":LABEL", "_json", f"de+{name}:string[]", f"{name}:string[]"]
    assert {tuple(r) for r in out.collect()} == {("o+class+a", "class", "{}", 'zwei', 'x\\u007Cy|zwei|q"t|drei'), ("o+class+b", "class", None, "", "")}
    export.write_csv(out, str(tmp_path / "nodes"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "nodes"))
    assert back.columns == out.columns and back.count() == 2
    assert export.graph_nodes(props.where("false"), kinds, rendered, "property").columns == ["id:ID", ":LABEL", "_json"]


def test_edge_file(spark):
    rows = [("a", "p", "b", {"n:m": ["1", "2|3"], "type": ["axiom"]}), ("a", "p", "c", None), ("a", "p", "d", {"k": []}), ("a", "relatedTo", "b", {"property": ["q"]})]
    out = export.edge_rows(spark.createDataFrame(rows, "src string, edge_type string, dst string, props map<string,array<string>>"))
    assert out.columns == [":START_ID", ":TYPE", ":END_ID", "_json", "k:string[]", "n__m:string[]"]
    assert {tuple(r) for r in out.collect()} == {
        ("a", "p", "b", '{"n:m":["1","2|3"],"type":["axiom"]}', "", "1|2\\u007C3"), ("a", "p", "c", "{}", "", ""),
        ("a", "p", "d", '{"k":[]}', "", ""), ("a", "relatedTo", "b", '{"property":["q"]}', "", ""),
    }
    assert export.edge_rows(spark.createDataFrame(rows[1:2], "src string, edge_type string, dst string, props map<string,array<string>>")).columns[-1] == "_json"


def test_saved_tables_join_without_a_shuffle(spark, tmp_path):
    nodes = spark.range(200).selectExpr("cast(id as string) id", "id % 7 n")
    edges = spark.range(400).selectExpr("cast(id % 200 as string) id", "id w")
    export.save_table(nodes, "saved_nodes", str(tmp_path / "nodes"), buckets=4)
    export.save_table(edges, "saved_edges", str(tmp_path / "edges"), buckets=4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = spark.table("saved_nodes").join(spark.table("saved_edges"), "id")
        assert both.count() == 400
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sql("drop table saved_nodes")
        spark.sql("drop table saved_edges")
