"""Legacy term records of a load: one row for each class, its lists gathered from rows by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import text
from ontoloom.functions import vocabulary as V
from ontoloom.operators import derive, shape
from ontoloom.plans.load import Load

KEY = derive.KEY


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(…, name): structs of an entity's rows, in order of their columns."""
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def _localised(loaded: Load, field: str, name: str, lang: str) -> DataFrame:
    """(…, name): values of the properties that ``field`` names for each entity, in the language asked for."""
    used = loaded.documents.select(F.col("ontologyId").alias("ontology_id"), F.col("iri").alias("id"), F.explode(field).alias("predicate")).distinct()
    rows = loaded.values.where("kind = 'literal'").join(used, [*KEY, "predicate"]).withColumns({"of": F.col("predicate"), "predicate": F.lit(name)})
    values = F.transform(F.array_sort(F.collect_list(F.struct("of", "pos", "value"))), lambda v: v["value"])
    return shape.localised(rows, lang).groupBy(*KEY).agg(F.array_distinct(values).alias(name))


def related(loaded: Load) -> DataFrame:
    """(…, related): an entity's relations to entities of its ontology, with the label of the property, or its local name."""
    part = lambda c, i: F.regexp_extract(c, r"^([^+]*)\+[^+]*\+(.*)$", i)
    rows = loaded.edges.where("edge_type = 'relatedTo'").select(
        part("src", 1).alias("ontology_id"), part("src", 2).alias("related_from_iri"), F.explode(F.col("props")["property"]).alias("iri"), part("dst", 2).alias("related_to_iri")
    ).distinct()
    labels = loaded.documents.where(F.col("type")[0] == "property").groupBy(F.col("ontologyId").alias("ontology_id"), "iri").agg(F.min(F.try_element_at("label", F.lit(1))).alias("label"))
    named = rows.join(labels, ["ontology_id", "iri"], "left").withColumn("label", F.coalesce("label", text.local_name(F.col("iri"))))
    named = named.withColumns({"id": F.col("related_from_iri"), "ontology_name": F.col("ontology_id")})
    return _listed(named, "related", "iri", "label", "ontology_name", "related_from_iri", "related_to_iri")


def terms(loaded: Load, lang: str = "en") -> DataFrame:
    """Legacy term records of all classes. is_preferred_root is never set in them; a list without members is null.

    Labels, descriptions and synonyms are in ``lang``, else untagged, else English; a class without such a label has its first one.
    """
    props = loaded.values.drop("axioms")
    found = derive.axioms(props)
    labels = shape.localised(props.where(F.col("predicate").isin(*V.LABELS) & (F.col("kind") == "literal")), lang)
    first = labels.groupBy(*KEY).agg(F.min_by("value", F.struct(F.array_position(F.array(*map(F.lit, V.LABELS)), F.col("predicate")).alias("rank"), F.col("pos"))).alias("own_label"))
    extra = [
        first,
        _localised(loaded, "definitionProperty", "description", lang),
        _localised(loaded, "synonymProperty", "synonyms", lang),
        shape.subsets(props),
        _listed(shape.definition_citations(found), "obo_definition_citation", "definition", "xref"),
        _listed(shape.xrefs(found), "obo_xref", "database", "xref_id", "description", "url"),
        _listed(shape.synonyms(found), "obo_synonym", "name", "scope", "type", "xrefs"),
        shape.replaced_by(props),
        related(loaded),
    ]
    out = loaded.documents.where(F.col("type")[0] == "class").withColumns({"ontology_id": F.col("ontologyId"), "key": F.col("iri")}).drop("id").withColumnRenamed("key", "id")
    for more in extra:
        out = out.join(more, KEY, "left")
    return out.select(
        "iri", F.lit(lang).alias("lang"), F.col("ontologyId").alias("ontology_name"), F.col("ontologyPreferredPrefix").alias("ontology_prefix"), F.col("ontologyIri").alias("ontology_iri"),
        F.col("shortForm").alias("short_form"), F.regexp_replace("shortForm", "_([^_]*)$", ":$1").alias("obo_id"), F.coalesce("own_label", F.try_element_at("label", F.lit(1))).alias("label"),
        "description", "synonyms", F.col("annotations").alias("annotation"), F.col("subsets").alias("in_subset"), "obo_definition_citation", "obo_xref", "obo_synonym",
        F.lit(False).alias("is_preferred_root"), F.col("isDefiningOntology").alias("is_defining_ontology"),
        (F.col("hasDirectChildren") | F.col("hasHierarchicalChildren")).alias("has_children"), (~(F.col("hasDirectParents") | F.col("hasHierarchicalParents"))).alias("is_root"),
        F.col("isObsolete").alias("is_obsolete"), "term_replaced_by", "related",
    )
