"""A load: from configurations of ontologies to the tables that ``service.Service`` and the exports read.

Files become triples, triples nodes and values; derivations add what the values imply; links say which ontology defines an entity. Everything is
rows of (ontology_id, id, field, pos, value) until a document is built from them in one aggregate, so no field costs a join of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.functions import vocabulary as V
from ontoloom.operators import closure, derive, export, link, linkdelta, mapping, shape
from ontoloom.plans.staging import staged
from ontoloom.session import ship_package
from ontoloom.sources import config as conf
from ontoloom.sources import rdf

KEY = derive.KEY
#: Fields of a document that hold several values, those that hold one, and flags.
LISTS = ("label", "definition", "synonym", "subset", "searchableAnnotationValues", "definitionProperty", "synonymProperty", "hierarchicalProperty", "oboSynonymTypeName", "appearsIn", "definedBy")
TEXTS = ("shortForm", "curie")
#: Derived lists: what ancestors, inverses, equivalents and disjoints a document has.
DERIVED = ("directAncestor", "hierarchicalAncestor", "inverseOf", "equivalentClass", "equivalentProperty", "disjointWith", "propertyDisjointWith", "differentFrom")
COUNTS = ("numDescendants", "numHierarchicalDescendants")
NEGATIVE = "negativePropertyAssertion+"
FLAGS = ("isObsolete", "isPreferredRoot", "isDefiningOntology", "imported", "hasIndividuals", "hasDirectParents", "hasDirectChildren", "hasHierarchicalParents", "hasHierarchicalChildren")
#: Config key -> predicates that a role has besides, and the predicates where the config names none.
ROLES = {"label_property": (V.LABELS, ()), "definition_property": (V.DEFINITIONS, ()), "synonym_property": (V.SYNONYMS, ()), "hierarchical_property": ((), (V.PART_OF,))}
#: Predicates whose values are fields of their own, not annotations.
NOT_NOTES = (*V.DEFINITIONS, *V.SYNONYMS, *V.PREFERRED_ROOT, V.PART_OF)
TOPS = (V.THING, V.TOP_PROPERTY)
#: Columns of ``sources.registries.prefix_registry``.
REGISTRY = "database string, prefix string, pattern string, uri_format string, uri_prefix string"


@dataclass(frozen=True)
class Load:
    """Tables of a load. ``values`` are ``props`` with axioms; ``documents`` and ``edges`` are what ``Service`` takes.

    ``linked`` says what each text or IRI of an ontology refers to; ``mentions`` which documents' values hold it; ``sources`` what links are made of, and ``link_tables``
    what they come to, for merges.
    """

    triples: DataFrame
    nodes: DataFrame
    values: DataFrame
    kinds: DataFrame
    documents: DataFrame
    edges: DataFrame
    ontologies: DataFrame
    imports: DataFrame
    definers: DataFrame
    linked: DataFrame
    mentions: DataFrame
    sources: linkdelta.Linked
    link_tables: linkdelta.Links

    def with_links(self) -> DataFrame:
        """``documents`` with ``linkedEntities``: for each text or IRI that a document mentions and that refers to something else, what that is, by text.

        Texts are a document's own, so its list is as long as they are; documents without links have an empty list.
        """
        told = self.mentions.join(self.linked, ["ontology_id", "s"]).where(~F.col("id").eqNullSafe(F.col("s")))
        shown = F.struct("s", *[c for c in self.linked.columns if c not in ("ontology_id", "s")])
        lists = told.groupBy(F.col("ontology_id").alias("ontologyId"), F.col("id").alias("iri")).agg(F.array_sort(F.collect_list(shown)).alias("linkedEntities"))
        out = self.documents.join(lists, ["ontologyId", "iri"], "left").select(*self.documents.columns, "linkedEntities")
        return out.withColumn("linkedEntities", F.coalesce("linkedEntities", F.array().cast(out.schema["linkedEntities"].dataType)))

    def write(self, path: str) -> None:
        """Documents as JSON lines by ontology and type, so that an ontology is a folder and no task holds one; edges by ontology; the ontologies."""
        export.write_json_lines(self.documents.withColumns({"ontology": F.col("ontologyId"), "kind": F.col("type")[0]}), f"{path}/documents", "ontology", "kind")
        export.write_json_lines(self.edges.withColumn("ontology", F.substring_index("src", "+", 1)), f"{path}/edges", "ontology")
        export.write_json_lines(self.ontologies, f"{path}/ontologies")


def mapping_sets(loaded: Load, registry: DataFrame, databases: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and prefixes of each ontology's mapping set (``mapping.mappings``), for ``mapping.write``. An entity maps where an ontology defines it.

    What values refer to is looked up in the load itself, then in ``registry``, ``databases`` and ``links`` (``link.linked_entities``).
    """
    docs = loaded.documents.where(F.col("type")[0] != "ontology")
    entities = docs.select(F.col("ontologyId").alias("ontology_id"), "iri", F.col("type")[0].alias("type"), F.try_element_at("label", F.lit(1)).alias("label"), "curie")
    spaces = settings(loaded.ontologies.withColumn("path", F.lit(None).cast("string")))
    bases = spaces.select("prefix", F.explode("base_uris").alias("base")).where("prefix is not null").distinct()
    values = loaded.values.where(F.col("predicate").isin(*mapping.PREDICATES, *mapping.STRUCTURES) & (F.col("kind") != "bnode"))
    linked = link.linked_entities(values.select("ontology_id", F.col("value").alias("s")), entities, loaded.definers, registry, bases, databases, links)
    first = F.min_by(F.struct("iri", "url", "curie", "label"), F.struct("source", "url", "iri", "label")).alias("f")
    linked = linked.groupBy("ontology_id", "s").agg(first).select("ontology_id", "s", "f.*")
    own = entities.withColumnRenamed("iri", "id").join(loaded.definers.select("ontology_id", F.col("iri").alias("id")), KEY, "left_semi")
    return mapping.mappings(values, own, linked)


def settings(configs: DataFrame) -> DataFrame:
    """(ontology_id, path, prefix, base_uris, preferred_root_term) of configurations with sources."""
    return configs.select("ontology_id", "path", conf.text_of("preferredPrefix").alias("prefix"), conf.list_of("base_uri").alias("base_uris"), conf.list_of("preferred_root_term").alias("preferred_root_term"))


def role_predicates(configs: DataFrame) -> DataFrame:
    """(ontology_id, role, predicate): a configured predicate joins the fixed ones of its role; hierarchical ones stand in for part-of."""
    def of(role: str, always: tuple, lacking: tuple) -> DataFrame:
        own = conf.list_of(role)
        fixed = F.array(*map(F.lit, always)).cast("array<string>")
        found = F.when(F.size(own) > 0, F.array_union(own, fixed)).otherwise(F.array(*map(F.lit, always + lacking)))
        return configs.select("ontology_id", F.lit(role).alias("role"), F.explode(found).alias("predicate"))

    return reduce(DataFrame.union, [of(role, *rule) for role, rule in ROLES.items()])


def load(spark: SparkSession, configs: DataFrame, resolve: dict[str, str] | None = None, registry: DataFrame | None = None, databases: DataFrame | None = None, links: DataFrame | None = None) -> Load:
    """Load the ontologies of ``configs`` (``config.with_sources``); ``resolve`` maps import IRIs to paths. Ontologies without a path are left out.

    What values refer to is looked up in the load itself, then in ``registry``, ``databases`` and ``links`` (``link.linked_entities``).
    The tables that several derivations read are staged, so a lost executor costs a re-read of them.
    """
    ship_package(spark)
    configs = staged(configs.where("path is not null"), "configs")
    config, roles = settings(configs), role_predicates(configs)
    _, triples = rdf.with_imports(spark, config.select("ontology_id", F.lit(0).alias("file_rank"), "path"), resolve or {})
    nodes, props = staged(derive.node_table(triples), "nodes"), staged(derive.prop_table(triples), "props")

    found = derive.axioms(props)
    hashes = derive.expression_hashes(props) if not found.where("kind = 'bnode'").isEmpty() else None
    values = staged(derive.reified(props, found, hashes), "values")

    tops = staged(derive.ontology_nodes(nodes, props, config), "ontologies")
    standing = tops.select("ontology_id", F.col("iri").alias("id"), F.lit("ontology").alias("type"))
    kinds = staged(export.entity_types(nodes).where("type <> 'ontology'").union(standing), "kinds")

    relations = staged(derive.related(nodes, props), "related")
    direct = staged(derive.direct_parents(nodes, props), "parents")
    upward = staged(derive.hierarchical_parents(nodes, props, relations, _role(roles, "hierarchical_property")), "hierarchy")
    shorts = derive.short_forms(nodes, config)
    labels = staged(derive.labels(nodes, props, shorts, _role(roles, "label_property")), "labels")

    named = kinds.join(shorts, KEY, "left").join(labels.groupBy(*KEY).agg(F.min_by("value", "pos").alias("label")), KEY, "left")
    entities = staged(named.where("type <> 'ontology'").select("ontology_id", F.col("id").alias("iri"), "type", "label", "curie"), "named")
    bases = config.select("ontology_id", F.explode("base_uris").alias("base"))
    sources = linkdelta.Linked(entities, linkdelta.statements(props), tops.select("ontology_id", "iri"), bases)
    definers = staged(link.defined_by(entities, bases, sources.stated()), "definers")
    entities = staged(link.repaired_curies(entities, definers), "entities")

    fields = [
        _field(labels, "label"),
        _field(derive.collated(nodes, props, _role(roles, "definition_property")), "definition"),
        _field(derive.collated(nodes, props, _role(roles, "synonym_property")), "synonym"),
        _field(_titles(props, tops), "label"),
        _texts(props.where(F.col("predicate") == V.OIO + "inSubset"), "subset", "value"),
        _texts(derive.searchable_values(nodes, props), "searchableAnnotationValues", "value"),
        _texts(derive.synonym_type_names(props), "oboSynonymTypeName", "name"),
        *[_texts(derive.used_predicates(nodes, props, _role(roles, r)), name, "predicate") for r, name in (("definition_property", "definitionProperty"), ("synonym_property", "synonymProperty"), ("hierarchical_property", "hierarchicalProperty"))],
        *_names(entities, definers, shorts),
        *_flags(nodes, props, config, kinds, definers, direct, upward),
        *_hierarchy(nodes, kinds, direct, upward),
        *_relations(nodes, props),
    ]
    notes = shape.annotations(props.where("kind <> 'bnode'"), labels.groupBy(*KEY).agg(F.min_by("value", "pos").alias("label")), NOT_NOTES)
    documents = staged(_documents(reduce(DataFrame.union, fields), kinds, nodes, tops, config, notes), "documents")
    edges = staged(_edges(values, kinds, direct, upward, relations), "edges")
    ontologies = staged(_ontologies(configs, tops, triples), "loaded")  # the time of this load, not of a later look
    mentions = staged(_mentions(props, kinds), "mentions")
    linked = staged(_linked(mentions, entities, definers, ontologies, registry, databases, links), "linked")
    tables = linkdelta.Links(link.definitions(entities), definers, link.unified_curies(entities, definers), linkdelta.import_counts(entities, definers))
    return Load(triples, nodes, values, kinds, documents, edges, ontologies, tables.imports.drop("n"), definers, linked, mentions, sources, tables)


def _linked(mentions: DataFrame, entities: DataFrame, definers: DataFrame, ontologies: DataFrame, registry: DataFrame | None, databases: DataFrame | None, links: DataFrame | None) -> DataFrame:
    known = registry if registry is not None else mentions.sparkSession.createDataFrame([], REGISTRY)
    spaces = settings(ontologies.withColumn("path", F.lit(None).cast("string"))).select("prefix", F.explode("base_uris").alias("base")).where("prefix is not null").distinct()
    return link.linked_entities(mentions.select("ontology_id", "s"), entities, definers, known, spaces, databases, links)


def merged(old: Load, new: Load, registry: DataFrame | None = None, databases: DataFrame | None = None, links: DataFrame | None = None) -> Load:
    """A load over an older one: the ontologies of ``new`` stand in for their old selves, and what links them to the others is brought up to date.

    Definers, import pairs and the links on documents of all ontologies change for the touched IRIs alone (``linkdelta``); what texts refer to is looked up
    anew, in the tables that ``load`` takes. Tables without links are plans over both loads; the rest are staged, so merges may follow one another. The result is that of loading all ontologies at once, but for the times of loads.
    """
    again = staged(new.ontologies.select("ontology_id"), "again")
    over = lambda a, b, key="ontology_id": a.join(again.withColumnRenamed("ontology_id", key), key, "left_anti").unionByName(b)
    sources = linkdelta.Linked(*[staged(t, "sources") for t in old.sources.replaced(again, new.sources).tables()])
    iris = staged(linkdelta.touched(old.sources, sources, again), "touched")
    now = linkdelta.merged(old.link_tables, old.sources, sources, again, iris).staged()
    documents = over(old.documents, new.documents, "ontologyId")
    documents = staged(linkdelta.relinked(documents, now, iris), "documents")
    source = F.substring_index("src", "+", 1)
    edges = old.edges.withColumn("ontology_id", source).join(again, "ontology_id", "left_anti").drop("ontology_id").unionByName(new.edges)
    ontologies, mentions = staged(over(old.ontologies, new.ontologies), "loaded"), staged(over(old.mentions, new.mentions), "mentions")
    linked = staged(_linked(mentions, link.repaired_curies(sources.entities, now.definers), now.definers, ontologies, registry, databases, links), "linked")
    own = (over(getattr(old, name), getattr(new, name)) for name in ("triples", "nodes", "values", "kinds"))
    return Load(*own, documents, edges, ontologies, now.imports.drop("n"), now.definers, linked, mentions, sources, now)


def _role(roles: DataFrame, role: str) -> DataFrame:
    return roles.where(F.col("role") == role)


def _field(values: DataFrame, name: str) -> DataFrame:
    """Rows of a field from values in order."""
    return values.select(*KEY, F.lit(name).alias("field"), F.col("pos").cast("long").alias("pos"), "value")


def _texts(rows: DataFrame, name: str, column: str) -> DataFrame:
    """Rows of a field whose values are a set: their order is the alphabet's."""
    return rows.select(*KEY, F.lit(name).alias("field"), F.lit(0).cast("long").alias("pos"), F.col(column).alias("value")).where("value is not null").distinct()


def _marks(rows: DataFrame, name: str) -> DataFrame:
    return _texts(rows.select(*KEY).withColumn("__m", F.lit("true")), name, "__m")


def _titles(props: DataFrame, tops: DataFrame) -> DataFrame:
    """Labels of the ontologies themselves."""
    own = tops.select("ontology_id", F.col("iri").alias("id"))
    rows = props.where(F.col("predicate").isin(*V.LABELS) & (F.col("kind") == "literal")).join(own, KEY, "left_semi")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*KEY).orderBy("predicate", "pos")) - 1)


def _names(entities: DataFrame, definers: DataFrame, shorts: DataFrame) -> list[DataFrame]:
    """Short form and curie of an entity, one for all its copies; which ontologies have it, and which define it."""
    one = link.unified_curies(entities, definers)
    each = shorts.select(*KEY, F.col("short_form").alias("own_short"), F.col("curie").alias("own")).join(one.withColumnRenamed("iri", "id"), "id", "left")
    whole = entities.select("ontology_id", F.col("iri").alias("id")).distinct()
    seen = whole.join(link.definitions(entities).select(F.col("iri").alias("id"), F.explode("appears_in").alias("o")), "id")
    by = whole.join(definers.select(F.col("iri").alias("id"), F.col("ontology_id").alias("o")), "id")
    return [
        _texts(each.withColumn("x", F.coalesce("curie", "own")), "curie", "x"),
        _texts(each.withColumn("x", F.coalesce("short_form", "own_short")), "shortForm", "x"),
        _texts(seen, "appearsIn", "o"), _texts(by, "definedBy", "o"),
    ]


def _flags(nodes: DataFrame, props: DataFrame, config: DataFrame, kinds: DataFrame, definers: DataFrame, direct: DataFrame, upward: DataFrame) -> list[DataFrame]:
    """A row for each flag that holds."""
    out = [
        _marks(derive.obsolete(nodes, props).where("is_obsolete"), "isObsolete"),
        _marks(derive.preferred_roots(nodes, props, config).where("is_preferred_root"), "isPreferredRoot"),
        _marks(definers.withColumnRenamed("iri", "id"), "isDefiningOntology"),
        _marks(nodes.where("imported"), "imported"),
        _marks(derive.has_individuals(nodes, props), "hasIndividuals"),
    ]
    ids = kinds.select(*KEY).distinct()
    for parents, name in ((direct, "Direct"), (upward, "Hierarchical")):
        edges = parents.select("ontology_id", F.col("id").alias("src"), F.col("parent").alias("dst")).distinct()
        flags = closure.hierarchy_flags(ids, edges, TOPS, ("ontology_id",))
        out += [_marks(flags.where("has_parents"), f"has{name}Parents"), _marks(flags.where("has_children"), f"has{name}Children")]
    return out


def _hierarchy(nodes: DataFrame, kinds: DataFrame, direct: DataFrame, upward: DataFrame) -> list[DataFrame]:
    """Ancestors, as rows throughout, and how many named nodes lie below each; hierarchical ancestors are told of classes only."""
    named, ids = nodes.where(~F.col("bnode")).select(*KEY), kinds.select(*KEY).distinct()
    classes = kinds.where("type = 'class'").select(*KEY)
    out = []
    for parents, list_, count, of in ((direct, "directAncestor", "numDescendants", named), (upward, "hierarchicalAncestor", "numHierarchicalDescendants", classes)):
        edges = parents.select("ontology_id", F.col("id").alias("src"), F.col("parent").alias("dst"))
        pairs = staged(closure.closure(edges, keys=("ontology_id",)).select("ontology_id", F.col("src").alias("id"), "dst"), "ancestors")
        below = pairs.join(named, KEY, "left_semi").groupBy("ontology_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        counts = ids.join(below, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("string"))
        out += [_texts(pairs.join(of, KEY, "left_semi"), list_, "dst"), _texts(counts, count, "n")]
    return out


def _relations(nodes: DataFrame, props: DataFrame) -> list[DataFrame]:
    """Inverses, equivalents, disjoints and differents in both directions where the statement has both, and negative assertions."""
    only = nodes.where(~F.array_contains("types", "class"))
    pairs = derive.pairwise(nodes, props)
    stated = lambda name: props.where((F.col("predicate") == V.OWL + name) & (F.col("kind") == "uri")).select(*KEY, "value")
    out = [
        _texts(derive.symmetric(nodes, props, V.OWL + "inverseOf", "property"), "inverseOf", "value"),
        _texts(derive.symmetric(nodes, props, V.OWL + "equivalentClass", "class"), "equivalentClass", "value"),
        _texts(derive.symmetric(only, props, V.OWL + "equivalentProperty", "property"), "equivalentProperty", "value"),
    ]
    for name in ("disjointWith", "propertyDisjointWith", "differentFrom"):
        listed = pairs.where(F.col("predicate") == V.OWL + name).select(*KEY, "value")
        out.append(_texts(listed.union(stated(name)), name, "value"))
    denied = derive.negative_assertions(props)
    return [*out, denied.select(*KEY, F.col("predicate").alias("field"), F.lit(0).cast("long").alias("pos"), "value").where("value is not null").distinct()]


def _mentions(props: DataFrame, kinds: DataFrame) -> DataFrame:
    """(ontology_id, id, s): what the values of each document may refer to: predicates, whole values, and parts of texts."""
    own = props.where(F.col("kind") != "bnode").where("value is not null").join(kinds.select(*KEY).distinct(), KEY, "left_semi")
    parts = F.array_union(F.array("predicate", "value"), link.references(F.col("value")))
    return own.select(*KEY, F.explode(parts).alias("s")).distinct()


def _documents(rows: DataFrame, kinds: DataFrame, nodes: DataFrame, tops: DataFrame, config: DataFrame, notes: DataFrame) -> DataFrame:
    """One row for each entity and kind: the rows of its fields meet in one map, the map's entries become columns."""
    lists = rows.groupBy(*KEY, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"]).alias("values"))
    fields = lists.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("m"))
    stamps = tops.select("ontology_id", F.col("iri").alias("ontology_iri")).join(config.select("ontology_id", "prefix"), "ontology_id", "left")
    out = kinds.join(fields, KEY, "left").join(notes, KEY, "left").join(nodes.select(*KEY, "types"), KEY, "left").join(stamps, "ontology_id", "left")
    finer = F.when(F.col("type") == "property", F.filter("types", lambda t: t.endswith("Property")))
    kind = F.array_union(F.array("type"), F.coalesce(finer, F.array().cast("array<string>")))
    shown = [export.entity_id(F.col("ontology_id"), F.col("type"), F.col("id")).alias("id"), F.col("id").alias("iri"), F.col("ontology_id").alias("ontologyId"), F.col("ontology_iri").alias("ontologyIri"), F.col("prefix").alias("ontologyPreferredPrefix"), kind.alias("type")]
    shown += [F.col("m")[n].alias(n) for n in LISTS] + [F.try_element_at(F.col("m")[n], F.lit(1)).alias(n) for n in TEXTS]
    denied = F.map_filter("m", lambda k, v: k.startswith(NEGATIVE))
    shown += [F.col("m")[n].alias(n) for n in DERIVED] + [F.try_element_at(F.col("m")[n], F.lit(1)).cast("long").alias(n) for n in COUNTS]
    shown.append(F.transform_keys(denied, lambda k, v: F.substr(k, F.lit(len(NEGATIVE) + 1))).alias("negativePropertyAssertions"))
    return out.select(*shown, "annotations", *[F.coalesce(F.map_contains_key("m", n), F.lit(False)).alias(n) for n in FLAGS])


def _edges(values: DataFrame, kinds: DataFrame, direct: DataFrame, upward: DataFrame, relations: DataFrame) -> DataFrame:
    """Stated values that are entities, and the derived parents and relations; a relation's edge names its property."""
    none = F.lit(None).cast("array<map<string,array<string>>>")
    row = lambda kind, value, notes: [*KEY, kind.alias("predicate"), F.lit("uri").alias("kind"), F.col(value).alias("value"), notes.alias("axioms")]
    property_of = F.array(F.create_map(F.lit("property"), F.array("property")))
    derived = [
        direct.select(*row(F.lit("directParent"), "parent", none)),
        upward.select(*KEY, "parent").distinct().select(*row(F.lit("hierarchicalParent"), "parent", none)),
        relations.select(*KEY, "property", "value").distinct().select(*row(F.lit("relatedTo"), "value", property_of)),
    ]
    stated = values.select(*KEY, "predicate", "kind", "value", "axioms")
    return export.graph_edges(reduce(lambda a, b: a.unionByName(b), derived, stated), kinds)


def _ontologies(configs: DataFrame, tops: DataFrame, triples: DataFrame) -> DataFrame:
    """(ontology_id, iri, stated, config, classes, properties, individuals, entities, languages, loaded, sourceFileTimestamp)."""
    own = configs.select("ontology_id", "config").join(tops, "ontology_id").join(derive.counters(triples), "ontology_id", "left")
    return own.join(rdf.file_times(configs), "ontology_id", "left").withColumn("loaded", F.current_timestamp()).select(*own.columns, "loaded", "sourceFileTimestamp")
