"""Display forms: class expressions as text, trees of entities with their roots, the annotations that are shown, merged axioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import text, vocabulary as V
from ontoloom.operators.closure import root_paths
from ontoloom.operators.derive import list_members
from ontoloom.plans.staging import staged

KEY = ["ontology_id", "id"]
# Words of class expressions, signs of datatype facets, and vocabularies whose properties count as annotations.
LISTS = (("intersectionOf", "(", " and ", ")"), ("unionOf", "(", " or ", ")"), ("oneOf", "{", ", ", "}"))
RESTRICTIONS = (
    ("someValuesFrom", "some"), ("allValuesFrom", "only"), ("hasValue", "value"), ("minCardinality", "min"), ("maxCardinality", "max"), ("cardinality", "exactly"),
)
QUALIFIED = (("minQualifiedCardinality", "min"), ("maxQualifiedCardinality", "max"), ("qualifiedCardinality", "exactly"))
FACETS = (("minExclusive", ">"), ("minInclusive", "≥"), ("maxExclusive", "<"), ("maxInclusive", "≤"))
INFORMAL = (V.SKOS, V.DC, V.DCT, "http://schema.org/", "https://schema.org/")
UNKNOWN = "unknown class expression"


def _expression(parts: Column) -> Column:
    """Text of a blank node from the texts of its values by predicate."""
    own = lambda name: parts[V.OWL + name]
    first = lambda name: F.try_element_at(own(name), F.lit(1))
    facets = F.concat_ws(" ", *[F.concat(F.lit(sign + " "), F.try_element_at(parts[V.XSD + name], F.lit(1))) for name, sign in FACETS])
    out = F.when(own("equivalentClass").isNotNull() & own("onProperty").isNull(), F.concat_ws(" ", F.try_element_at(parts[V.LABEL], F.lit(1)), first("equivalentClass")))
    for name, left, between, right in LISTS:
        out = out.when(own(name).isNotNull(), F.concat(F.lit(left), F.array_join(own(name), between), F.lit(right)))
    out = out.when(own("complementOf").isNotNull(), F.concat(F.lit("not "), first("complementOf")))
    out = out.when(own("inverseOf").isNotNull(), F.concat(F.lit("inverse ("), first("inverseOf"), F.lit(")")))
    limits = F.when(F.size(own("withRestrictions")) > 0, F.concat(F.lit("["), F.array_join(own("withRestrictions"), ", "), F.lit("]")))
    out = out.when(own("onDatatype").isNotNull(), F.concat_ws("", first("onDatatype"), limits))
    out = out.when(facets != "", facets).when(own("onProperty").isNull(), F.lit(UNKNOWN))
    for name, word in RESTRICTIONS:
        out = out.when(own(name).isNotNull(), F.concat_ws(" ", first("onProperty"), F.lit(word), first(name)))
    out = out.when(own("hasSelf").isNotNull(), F.concat_ws(" ", first("onProperty"), F.lit("Self")))
    for name, word in QUALIFIED:
        out = out.when(own(name).isNotNull(), F.concat_ws(" ", first("onProperty"), F.lit(word), first(name), F.coalesce(first("onClass"), first("onDataRange"))))
    return out.otherwise(F.lit(UNKNOWN))


def class_expressions(props: DataFrame, names: DataFrame) -> DataFrame:
    """(…, text) of every blank node that is no cell of a list; names: ontology_id, id, label.

    IRIs show as their label, else their local name; literals as they are. Built bottom-up, a level of nesting in each round: a node is
    written once the blank nodes it names are. Nodes on a cycle have no row.
    """
    cells = props.where(F.col("predicate").isin(V.FIRST, V.REST)).select(*KEY).distinct()
    # a list takes the place of its head cell, its members that of the cell's values
    members = list_members(props).select("ontology_id", F.col("list").alias("id"), F.lit("").alias("predicate"), "pos", "kind", F.col("member").alias("value"))
    plain = props.where(F.col("id").startswith("_:") & (F.col("predicate") != V.TYPE)).select(*KEY, "predicate", F.col("pos").cast("long").alias("pos"), "kind", "value").join(cells, KEY, "left_anti")
    labels = names.groupBy("ontology_id", F.col("id").alias("value")).agg(F.min("label").alias("label"))
    rows = plain.union(members).join(labels, ["ontology_id", "value"], "left")
    shown = F.when(F.col("kind") == "uri", F.coalesce("label", text.local_name(F.col("value")))).when(F.col("kind") == "literal", F.col("value"))
    # an empty list has no cells of its own
    shown = F.when(F.col("value") == V.NIL, F.array().cast("array<string>")).when(shown.isNotNull(), F.array(shown))
    rows = staged(rows.select(*KEY, "predicate", "pos", "value", shown.alias("parts")), "expressions")
    done = None
    while True:
        todo = rows
        if done is not None:
            inner = done.select("ontology_id", F.col("id").alias("value"), F.col("parts").alias("inner"))
            todo = rows.join(done, KEY, "left_anti").join(inner, ["ontology_id", "value"], "left").withColumn("parts", F.coalesce("parts", "inner")).drop("inner")
        ready = todo.join(todo.where("parts is null").select(*KEY).distinct(), KEY, "left_anti")
        by = ready.groupBy(*KEY, "predicate").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "parts"))), lambda v: v["parts"])).alias("parts"))
        node = by.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("predicate", "parts"))).alias("m"))
        is_list = F.map_contains_key("m", F.lit(""))
        new = staged(node.select(*KEY, is_list.alias("is_list"), F.when(is_list, F.col("m")[""]).otherwise(F.array(_expression(F.col("m")))).alias("parts")), "expression")
        if done is not None and new.isEmpty():
            break
        done = new if done is None else done.union(new)
    return done.where("not is_list").select(*KEY, F.col("parts")[0].alias("text"))


def visible_edges(nodes: DataFrame, edges: DataFrame, top: tuple[str, ...] = (V.THING, V.TOP_PROPERTY)) -> DataFrame:
    """(src, dst) whose two ends are both shown; the top class and property are never parents."""
    kept = edges.where(~F.col("dst").isin(*top)).select("src", "dst").distinct()
    return kept.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def tree(nodes: DataFrame, edges: DataFrame, root: str | None = None, preferred: str | None = None) -> DataFrame:
    """(id, node_id, parent_id, depth, n_below) of each place of a node in the tree shown.

    Roots are the one asked for; else those flagged in the column ``preferred``, if any; else nodes without a shown parent. An edge back
    to a node of its own path is not followed. n_below is num_hierarchical_descendants, or num_descendants where that is 0 or absent.
    """
    shown = visible_edges(nodes, edges)
    tops = None
    if root is not None:
        tops = nodes.where(F.col("id") == root)
    elif preferred is not None and not (flagged := nodes.where(F.col(preferred))).isEmpty():
        tops = flagged
    # the chosen roots lose their parents, and nothing hangs from what is no root and has none
    down = shown if tops is None else shown.join(tops.select(F.col("id").alias("src")), "src", "left_anti")
    paths = root_paths(nodes.select("id"), down)
    if tops is not None:
        paths = paths.where(F.size("path") > 0).join(tops.select(F.col("id").alias("__top")), F.col("path")[0] == F.col("__top"), "left_semi")
    size = F.size("path")
    parent = F.when(size == 1, F.lit("#")).otherwise(text.path_id(F.slice("path", F.lit(1), size - 1)))
    counts = [F.col(c) for c in ("num_hierarchical_descendants", "num_descendants") if c in nodes.columns]
    below = F.coalesce(*[F.nullif(c, F.lit(0)) for c in counts], F.lit(0)) if counts else F.lit(0)
    n = nodes.select("id", below.cast("long").alias("n_below"))
    return paths.join(n, "id").select("id", text.path_id(F.col("path")).alias("node_id"), parent.alias("parent_id"), size.cast("long").alias("depth"), "n_below")


def annotation_predicates(props: DataFrame, nodes: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(…, predicate) that an entity's page lists as annotations.

    IRIs outside rdf, rdfs and owl (comment, seeAlso and disjointUnionOf stay), not among ``hidden``, and no object or data property of
    the ontology unless of an informal vocabulary.
    """
    p = F.col("predicate")
    formal = F.array_contains("types", "objectProperty") | F.array_contains("types", "dataProperty")
    logical = nodes.where(formal).select("ontology_id", F.col("id").alias("predicate")).where(~_any_prefix(p, INFORMAL))
    kept = p.isin(V.RDFS + "comment", V.RDFS + "seeAlso", V.OWL + "disjointUnionOf") | ~_any_prefix(p, (V.RDF, V.RDFS, V.OWL))
    rows = props.where(kept & p.contains("://") & ~p.isin(*hidden, V.OIO + "inSubset")) if hidden else props.where(kept & p.contains("://") & ~p.isin(V.OIO + "inSubset"))
    return rows.join(logical, ["ontology_id", "predicate"], "left_anti").select(*KEY, "predicate").distinct()


def _any_prefix(column: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | column.startswith(prefix)
    return out


def merged_axioms(reified: DataFrame) -> DataFrame:
    """(…, predicate, value, annotations): the axioms on each value as one map; a predicate's values are joined, each once, in order."""
    rows = reified.where("axioms is not null").select(*KEY, "predicate", "value", F.explode("axioms").alias("a"))
    each = rows.select(*KEY, "predicate", "value", F.explode("a").alias("note", "vs")).select(*KEY, "predicate", "value", "note", F.explode("vs").alias("v"))
    lists = each.groupBy(*KEY, "predicate", "value", "note").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    return lists.groupBy(*KEY, "predicate", "value").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("note", "vs")))).alias("annotations"))
