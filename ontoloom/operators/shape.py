"""Shapes of API answers: localised values, legacy term records, annotations, synonyms, cross references, hierarchies for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import text, vocabulary as V

KEY = ["ontology_id", "id"]


def localised(props: DataFrame, lang: str, default: str = "en") -> DataFrame:
    """Values of each key in the language asked for, else the untagged, else the default's; URIs always stay.

    The choice is made for the key as a whole, by an aggregate of the best rank and a semi-join on it. ``all`` keeps everything.
    """
    if lang == "all":
        return props
    tag = F.lower(F.coalesce("lang", F.lit("")))
    rank = F.when(F.col("kind") != "literal", 0).when(tag == lang.lower(), 0).when(tag == "", 1).when(tag == default, 2)
    ranked = props.withColumn("__rank", rank).where("__rank is not null")
    best = ranked.groupBy(*KEY, "predicate").agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, [*KEY, "predicate", "__rank"], "left_semi").drop("__rank")


def annotations(props: DataFrame, names: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """(…, annotations): label or local name of each annotation predicate -> its values in order, each once.

    Definition, synonym and hierarchy predicates (``hidden``) and the rdf, rdfs and owl namespaces are left out, but for comment and seeAlso.
    """
    shown = F.col("predicate").isin(V.RDFS + "comment", V.RDFS + "seeAlso") | ~(F.col("predicate").startswith(V.RDF) | F.col("predicate").startswith(V.RDFS) | F.col("predicate").startswith(V.OWL))
    rows = props.where(shown & F.col("predicate").contains("://") & ~F.col("predicate").isin(*hidden, V.OIO + "inSubset"))
    rows = rows.join(names.select("ontology_id", F.col("id").alias("predicate"), F.col("label").alias("name")), ["ontology_id", "predicate"], "left")
    rows = rows.select(*KEY, F.coalesce("name", text.local_name(F.col("predicate"))).alias("name"), F.struct("predicate", "pos").alias("at"), "value")
    once = rows.groupBy(*KEY, "name", "value").agg(F.min("at").alias("at"))
    lists = once.groupBy(*KEY, "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda v: v["value"]).alias("values"))
    return lists.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "values")))).alias("annotations"))


def subsets(props: DataFrame) -> DataFrame:
    """(…, subsets): local names of inSubset, in order."""
    rows = props.where(F.col("predicate") == V.OIO + "inSubset").select(*KEY, text.local_name(F.col("value")).alias("s"))
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_set("s")).alias("subsets"))


def synonyms(found: DataFrame) -> DataFrame:
    """(…, name, scope, type, xrefs) of reified synonyms (``derive.axioms``), each once."""
    scope = F.regexp_extract("predicate", "has(Exact|Related|Narrow|Broad)Synonym$", 1)
    rows = found.where(scope != "")
    note = lambda p: F.col("annotations")[V.OIO + p]
    return rows.select(*KEY, F.col("value").alias("name"), scope.alias("scope"), F.try_element_at(note("hasSynonymType"), F.lit(1)).alias("type"), note("hasDbXref").alias("xrefs")).distinct()


def definition_citations(found: DataFrame, predicates: tuple[str, ...] = V.DEFINITIONS) -> DataFrame:
    """(…, definition, xref): sources of definitions."""
    rows = found.where(F.col("predicate").isin(*predicates))
    return rows.select(*KEY, F.col("value").alias("definition"), F.explode(F.col("annotations")[V.OIO + "hasDbXref"]).alias("xref")).distinct()


def xrefs(found: DataFrame) -> DataFrame:
    """(…, database, xref_id, description, url) of reified cross references: the last source, else the last label, describes one."""
    rows = found.where(F.col("predicate") == V.OIO + "hasDbXref")
    last = lambda p: F.try_element_at(F.col("annotations")[p], F.lit(-1))
    x = text.xref(F.col("value"))
    return rows.select(*KEY, x["database"].alias("database"), x["id"].alias("xref_id"), F.coalesce(last(V.OIO + "source"), last(V.LABEL)).alias("description"), F.coalesce(last(V.OIO + "url"), x["url"]).alias("url")).distinct()


def replaced_by(props: DataFrame) -> DataFrame:
    """(…, term_replaced_by): the first replacement; of an IRI its short form."""
    first = props.where(F.col("predicate") == V.OBO + "IAO_0100001").groupBy(*KEY).agg(F.min_by(F.struct("value", "kind"), "pos").alias("r"))
    return first.select(*KEY, F.when(F.col("r.kind") == "uri", text.local_name(F.col("r.value"))).otherwise(F.col("r.value")).alias("term_replaced_by"))


def rendered(props: DataFrame, plain: bool = False) -> DataFrame:
    """(…, json): each node's properties as JSON, blank nodes nested and lists as arrays, built bottom-up.

    Keys that are no IRIs come first, then all by name; null values are left out. A literal is an object with its language and datatype, or
    its bare value if ``plain``. A value with ``axioms`` (``derive.reified``), if that column is there, is an object of the value and them.
    A blank node that nothing describes renders as an empty text; blank nodes on a cycle are left out.
    """
    from ontoloom.operators.derive import VALUE, flat_lists
    from ontoloom.plans.staging import staged

    props = props.where("value is not null")
    rows = flat_lists(props)
    if "axioms" in props.columns:
        notes = props.where("axioms is not null").select(*KEY, "predicate", F.col("pos").cast("long").alias("pos"), *VALUE[:2], F.to_json("axioms").alias("notes"))
        rows = rows.join(notes, [*KEY, "predicate", "pos", *VALUE[:2]], "left")
    else:
        rows = rows.withColumn("notes", F.lit(None).cast("string"))
    described = rows.select("ontology_id", F.col("id").alias("value")).distinct().withColumn("there", F.lit(True))
    rows = staged(rows.join(described, ["ontology_id", "value"], "left"), "render")
    scalar = F.when(F.col("kind") == "uri", F.to_json(F.array("value"))).when(F.col("kind") == "bnode", F.when(F.col("there").isNull(), F.lit('[""]')))
    literal = F.when(F.col("datatype").isin(V.XSD + "boolean", V.XSD + "integer", V.XSD + "int", V.XSD + "double"), F.concat(F.lit("["), F.lower("value"), F.lit("]")))
    tagged = F.to_json(F.array(F.struct(F.array(F.lit("literal")).alias("type"), F.col("value"), F.when(F.col("lang") != "", F.col("lang")).alias("lang"), F.when(~F.col("datatype").isin("", V.XSD + "string"), F.col("datatype")).alias("datatype"))))
    bare = F.to_json(F.array("value"))
    one = F.when(F.col("kind") == "literal", F.coalesce(literal, bare if plain else tagged)).otherwise(scalar)
    rows = rows.withColumn("text", one).withColumn("text", F.expr("substring(text, 2, length(text) - 2)"))
    done = None
    while True:
        todo = rows
        if done is not None:
            nested = done.select("ontology_id", F.col("id").alias("value"), F.col("json").alias("inner"))
            todo = rows.join(done, KEY, "left_anti").join(nested, ["ontology_id", "value"], "left").withColumn("text", F.coalesce("text", "inner")).drop("inner")
        ready = todo.join(todo.where("text is null").select(*KEY).distinct(), KEY, "left_anti")
        wrapped = F.concat(F.lit('{"type":["reification"],"value":'), "text", F.lit(',"axioms":'), "notes", F.lit("}"))
        ready = ready.withColumn("text", F.when(F.col("notes").isNotNull(), wrapped).otherwise(F.col("text")))
        values = ready.groupBy(*KEY, "predicate").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda v: v["text"]).alias("v"))
        array = F.concat(F.lit("["), F.array_join("v", ","), F.lit("]"))
        field = F.concat(F.regexp_extract(F.to_json(F.array("predicate")), r"^\[(.*)\]$", 1), F.lit(":"), F.when(F.size("v") == 1, F.col("v")[0]).otherwise(array))
        whole = values.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("predicate").contains("://").alias("iri"), "predicate", field.alias("f"), array.alias("a")))).alias("fs"))
        as_list = (F.size("fs") == 1) & (F.col("fs")[0]["predicate"] == "")
        json = F.when(as_list, F.col("fs")[0]["a"]).otherwise(F.concat(F.lit("{"), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("}")))
        new = staged(whole.select(*KEY, json.alias("json")), "rendered")
        if done is not None and new.isEmpty():
            break
        done = new if done is None else done.union(new)
    return done


def _texts(values: DataFrame, name: str) -> DataFrame:
    """(…, name): an entity's values as one array, in order."""
    return values.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"]).alias(name))


def properties(labels: DataFrame, shorts: DataFrame, flags: DataFrame, definitions: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """Legacy property records: iri, label, short_form, obo_id, has_children, is_root, description, synonyms. Every underscore of an obo_id is a colon."""
    return _records(labels, shorts, definitions, synonyms, flags).withColumn("obo_id", F.replace("short_form", F.lit("_"), F.lit(":")))


def individuals(labels: DataFrame, shorts: DataFrame, definitions: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """Legacy records of individuals: iri, label, short_form, obo_id, description, synonyms."""
    return _records(labels, shorts, definitions, synonyms).withColumn("obo_id", F.replace("short_form", F.lit("_"), F.lit(":")))


def _records(labels: DataFrame, shorts: DataFrame, definitions: DataFrame | None, synonyms: DataFrame | None, flags: DataFrame | None = None) -> DataFrame:
    label = labels.groupBy(*KEY).agg(F.min("value").alias("label"))
    out = shorts.join(label, KEY, "left")
    for values, name in ((definitions, "description"), (synonyms, "synonyms")):
        out = out.join(_texts(values, name), KEY, "left") if values is not None else out.withColumn(name, F.lit(None).cast("array<string>"))
    shown = ["ontology_id", F.col("id").alias("iri"), "label", "short_form", "description", "synonyms"]
    if flags is not None:
        no = F.lit(False)
        out = out.join(flags, KEY, "left")
        shown += [F.coalesce("has_children", no).alias("has_children"), (~F.coalesce("has_parents", no)).alias("is_root")]
    return out.select(*shown)


def ontologies(configs: DataFrame, nodes: DataFrame, props: DataFrame, counts: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Legacy records of ontologies: config (map of JSON texts), title, description, version, counts, languages, status, and when loaded and updated.

    ``times`` has ontology_id, loaded and sourceFileTimestamp, as a load's ontologies do; without it both are null. ``nodes`` is ``derive.ontology_nodes``, ``counts`` ``derive.counters``. What the ontology itself states as dc:title and dc:description
    stands before the config's; of several values the alphabetically first. The version is the ontology's versionInfo.
    """
    own = nodes.select("ontology_id", F.col("iri").alias("id"))
    value = lambda p: F.min(F.when(F.col("predicate") == p, F.col("value")))
    stated = props.join(own, KEY, "left_semi").groupBy("ontology_id").agg(
        value(V.DC + "title").alias("t"), value(V.DC + "description").alias("d"), value(V.OWL + "versionInfo").alias("version"), value(V.OWL + "versionIRI").alias("version_iri")
    )
    plain = lambda n: F.get_json_object(F.concat(F.lit('{"x":'), F.col("config")[n], F.lit("}")), "$.x")
    out = configs.join(own.withColumnRenamed("id", "iri"), "ontology_id", "left").join(stated, "ontology_id", "left").join(counts, "ontology_id", "left")
    zero = F.lit(0).cast("long")
    when = times.select("ontology_id", "loaded", F.col("sourceFileTimestamp").alias("updated")) if times is not None else None
    none = F.lit(None).cast("timestamp")
    out = out.join(when, "ontology_id", "left") if when is not None else out.withColumns({"loaded": none, "updated": none})
    return out.select(
        "ontology_id", "iri", F.coalesce("t", plain("title")).alias("title"), F.coalesce("d", plain("description")).alias("description"), "version", "version_iri",
        plain("preferredPrefix").alias("preferred_prefix"), F.coalesce(plain("label_property"), F.lit(V.LABEL)).alias("label_property"),
        *[F.coalesce(c, zero).alias(f"number_of_{n}") for c, n in (("classes", "terms"), ("properties", "properties"), ("individuals", "individuals"))],
        "languages", F.lit("LOADED").alias("status"), "loaded", "updated", "config",
    )
