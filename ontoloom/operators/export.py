"""Exports: property-graph nodes and edges, flat search documents, autocomplete rows, merges of loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import vocabulary as V
from ontoloom.plans.staging import staged

KEY = ["ontology_id", "id"]


def entity_id(ontology: Column, kind: Column, iri: Column) -> Column:
    return F.concat_ws("+", ontology, kind, iri)


def entity_types(nodes: DataFrame) -> DataFrame:
    """(ontology_id, id, type): a row for each kind of entity that a named node is; a punned IRI has several."""
    kept = F.array_intersect("types", F.array(*map(F.lit, (*V.ENTITY_TYPES, "ontology"))))
    return nodes.where(~F.col("bnode")).select(*KEY, F.explode(kept).alias("type"))


def graph_edges(props: DataFrame, kinds: DataFrame) -> DataFrame:
    """(src, edge_type, dst, props): every value that is an entity of the same ontology; one edge for each axiom on it.

    Both ends fan out over the kinds they have. ``props`` may carry an array ``axioms`` of annotation maps. Rows with axioms are wide in memory, though they travel
    well, so they pass by hash tables of the narrow kinds and are not sorted.
    """
    if "axioms" not in props.columns:
        props = props.withColumn("axioms", F.lit(None).cast("array<map<string,array<string>>>"))
    rows = props.where((F.col("kind") == "uri") & ~F.col("predicate").isin(*V.HIDDEN_EDGES)).select(*KEY, "predicate", "value", F.explode_outer("axioms").alias("props"))
    a = kinds.select("ontology_id", "id", entity_id(F.col("ontology_id"), F.col("type"), F.col("id")).alias("src"))
    b = kinds.select("ontology_id", F.col("id").alias("value"), entity_id(F.col("ontology_id"), F.col("type"), F.col("id")).alias("dst"))
    return rows.join(a.hint("shuffle_hash"), KEY).join(b.hint("shuffle_hash"), ["ontology_id", "value"]).select("src", F.col("predicate").alias("edge_type"), "dst", "props")


def search_documents(props: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, ontology_id, iri, type, fields): a map of field name (colons doubled to underscores) to values in order."""
    shown = props.where(~F.col("predicate").isin(*V.HIDDEN_PROPERTIES) & F.col("value").isNotNull() & (F.col("kind") != "bnode"))
    values = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"])
    by_field = shown.groupBy(*KEY, F.replace("predicate", F.lit(":"), F.lit("__")).alias("field")).agg(values.alias("values"))
    fields = by_field.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "values")))).alias("fields"))
    return kinds.join(fields, KEY, "left").select(entity_id(F.col("ontology_id"), F.col("type"), F.col("id")).alias("doc_id"), "ontology_id", F.col("id").alias("iri"), "type", "fields")


def autocomplete(labels: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(ontology_id, id, label): one row for each label and synonym."""
    return labels.select(*KEY, F.col("value").alias("label")).union(synonyms.select(*KEY, F.col("value").alias("label")))


def columns_of(props: DataFrame, kinds: DataFrame) -> DataFrame:
    """(ontology_id, type, column): the columns an export of each kind needs; other languages than English have further columns of their own."""
    return props.join(kinds, KEY).select("ontology_id", "type", F.explode(_columns()).alias("column")).distinct()


def _columns() -> Column:
    """The columns a value is shown in: that of its predicate, and the one of its language and predicate."""
    other = ~F.coalesce("lang", F.lit("")).isin("", "en")
    return F.array_compact(F.array("predicate", F.when(other, F.concat("lang", F.lit("+"), "predicate"))))


def header(column: str) -> str:
    """A column's name in a file, where a colon parts name and type."""
    return column if column == "iri" else column.replace(":", "__") + ":string[]"


def csv_value(values: Column) -> Column:
    """Values joined by a pipe; pipes inside them are escaped."""
    return F.array_join(F.transform(values, lambda v: F.replace(v, F.lit("|"), F.lit("\\u007C"))), "|")


def graph_nodes(props: DataFrame, kinds: DataFrame, rendered: DataFrame, kind: str) -> DataFrame:
    """Rows of the node file of a kind: ``id:ID``, ``:LABEL``, ``_json`` and a column for each name of ``columns_of``, in order (``header``).

    A predicate's column has its values in all languages, a language's column the first in that language. The names are the predicates a kind uses, a matter of
    the schema; they are read once to fix the header, the values stay rows until they meet in a map of a node. ``rendered`` holds each node's JSON
    (ontology_id, id, json). A node without values has empty columns.
    """
    own = kinds.where(F.col("type") == kind)
    shown = props.where(~F.col("predicate").isin(*V.HIDDEN_PROPERTIES) & (F.col("kind") != "bnode") & F.col("value").isNotNull())
    names = sorted(r["column"] for r in columns_of(shown, own).select("column").distinct().collect())
    rows = shown.join(own.select(*KEY), KEY, "left_semi").select(*KEY, "predicate", "pos", "value", F.explode(_columns()).alias("column"))
    values = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"])
    lists = rows.groupBy(*KEY, "column", (F.col("column") == F.col("predicate")).alias("whole")).agg(values.alias("values"))
    lists = lists.withColumn("text", csv_value(F.when(F.col("whole"), F.col("values")).otherwise(F.slice("values", 1, 1))))
    by_node = lists.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m"))
    out = own.join(by_node, KEY, "left").join(rendered.select(*KEY, "json"), KEY, "left")
    cells = [F.coalesce(F.try_element_at("m", F.lit(n)), F.lit("")).alias(header(n)) for n in names]
    return out.select(entity_id(F.col("ontology_id"), F.col("type"), F.col("id")).alias("id:ID"), F.lit(kind).alias(":LABEL"), F.col("json").alias("_json"), *cells)


def edge_rows(edges: DataFrame) -> DataFrame:
    """Rows of the edge file: ``:START_ID``, ``:TYPE``, ``:END_ID``, the edge's properties as ``_json``, and a column for each property that axioms have.

    The edges are staged, so that what they are made of is joined once; the names are read from there, as those of nodes are. What a relation says of itself (its property) is in ``_json`` alone. An edge without a property has it empty.
    """
    edges = staged(edges, "edge-rows")
    said = edges.where(F.col("edge_type") != "relatedTo").select(F.explode(F.map_keys("props")).alias("name")).distinct()
    names = sorted(r["name"] for r in said.where(~F.col("name").isin("type", *V.HIDDEN_PROPERTIES)).collect())
    cells = [F.coalesce(csv_value(F.try_element_at("props", F.lit(n))), F.lit("")).alias(header(n)) for n in names]
    return edges.select(F.col("src").alias(":START_ID"), F.col("edge_type").alias(":TYPE"), F.col("dst").alias(":END_ID"), F.coalesce(F.to_json("props"), F.lit("{}")).alias("_json"), *cells)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).json(path)


def save_table(df: DataFrame, name: str, path: str, key: str = "id", buckets: int = 64) -> None:
    """A table bucketed and sorted by its key: joins of such tables on the key shuffle nothing, and a lookup reads one bucket."""
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def merged(old: DataFrame, new: DataFrame, key: str = "ontology_id") -> DataFrame:
    """A new load over an old one: ontologies that were not loaded again keep their old rows."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))
