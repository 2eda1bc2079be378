"""Links across ontologies: who defines an IRI, imports, references in strings, prefixes and CURIEs.

``entities`` holds ontology_id, iri, type, label, curie; ``registry`` holds prefix, uri_prefix and pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import text, vocabulary as V
from ontoloom.plans.spread import small


def definitions(entities: DataFrame) -> DataFrame:
    """(iri, n_definitions, appears_in): how many (ontology, type) pairs have an IRI, and in which ontologies, in order."""
    each = entities.select("iri", "ontology_id", "type").distinct().groupBy("iri")
    return each.agg(F.count(F.lit(1)).alias("n_definitions"), F.array_sort(F.collect_set("ontology_id")).alias("appears_in"))


def defined_by(entities: DataFrame, bases: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """(iri, ontology_id): ontologies that have an IRI and define it, by a base URI (ontology_id, base) it starts with or by statement (iri, ontology_id)."""
    return lists(entities, bases, stated).select("iri", F.explode("definers").alias("ontology_id"))


def own_claims(entities: DataFrame, bases: DataFrame) -> DataFrame:
    """``entities`` with ``said``: the row's ontology where the IRI starts with one of its bases, else null."""
    stem = bases.where(F.length("base") > 0).select("ontology_id", "base")
    own = small(stem.groupBy("ontology_id").agg(F.collect_set("base").alias("__bases")), stem)
    says = F.coalesce(F.exists("__bases", lambda base: F.col("iri").startswith(base)), F.lit(False))
    return entities.join(own, "ontology_id", "left").select(*entities.columns, F.when(says, F.col("ontology_id")).alias("said"))


#: Signs before an ontology's name: it has an IRI, has and defines it, is said to define it, had it.
HAS, OWNS, SAID, HAD = "+", "*", "=", "-"


def marks(entities: DataFrame, bases: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """(iri, mark): what makes an IRI's lists, an ontology and its part in one text. Null IRIs are left out."""
    own = own_claims(entities.select("iri", "ontology_id"), bases)
    rows = own.select("iri", F.concat(F.when(F.col("said").isNull(), HAS).otherwise(OWNS), "ontology_id").alias("mark"))
    if stated is not None:
        rows = rows.union(stated.select("iri", F.concat(F.lit(SAID), "ontology_id")))
    return rows.where("iri is not null")


def marked(column: str, *signs: str) -> Column:
    """The ontologies that have one of the signs in an array of marks; none where this is null."""
    found = F.filter(column, lambda m: F.substring(m, 1, 1).isin(*signs))
    return F.coalesce(F.transform(found, lambda m: F.substring(m, 2, (1 << 31) - 1)), F.array().cast("array<string>"))


def lists(entities: DataFrame, bases: DataFrame, stated: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(iri, appears_in, definers): the ontologies that have an IRI, and those of them that define it, in order; of all IRIs or those in ``only`` (iri)."""
    met = marks(entities, bases, stated).groupBy("iri").agg(F.collect_set("mark").alias("marks"))
    if only is not None:
        met = met.join(only, "iri", "left_semi")
    met = met.withColumn("appears_in", F.array_sort(marked("marks", HAS, OWNS))).where(F.size("appears_in") > 0)
    return met.select("iri", "appears_in", F.array_intersect("appears_in", marked("marks", OWNS, SAID)).alias("definers"))


def by_iri(entities: DataFrame, bases: DataFrame, stated: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(iri, n_definitions, appears_in, definers, curie): what ``definitions``, ``defined_by`` and ``unified_curies`` say of each IRI, or of those in ``only`` (iri).

    An ontology defines an IRI only if it has it, so each row is held against its own ontology's bases, and rows and statements meet in one shuffle by IRI.
    """
    copy = F.struct("ontology_id", "type", F.when(F.col("curie").contains(":"), 0).otherwise(1).alias("plain"), "curie")
    rows = own_claims(entities, bases).select("iri", "said", copy.alias("copy"))
    if stated is not None:
        rows = rows.union(stated.where("iri is not null").select("iri", F.col("ontology_id").alias("said"), F.lit(None).cast(rows.schema["copy"].dataType).alias("copy")))
    met = rows.groupBy("iri").agg(F.collect_set("copy").alias("copies"), F.collect_set("said").alias("said")).where(F.size("copies") > 0)
    if only is not None:
        met = met.join(only, "iri", "left_semi")
    met = met.withColumn("appears_in", F.array_sort(F.array_compact(F.array_distinct(F.col("copies.ontology_id")))))
    met = met.withColumn("definers", F.array_intersect("appears_in", "said"))
    ranked = F.transform("copies", lambda c: F.struct(F.when(F.array_contains("definers", c["ontology_id"]), 0).otherwise(1).alias("d"), c["plain"].alias("plain"), c["ontology_id"].alias("ontology_id"), c["curie"].alias("curie")))
    types = F.array_distinct(F.transform("copies", lambda c: F.struct(c["ontology_id"].alias("o"), c["type"].alias("t"))))
    return met.select("iri", F.size(types).cast("long").alias("n_definitions"), "appears_in", "definers", F.array_min(ranked)["curie"].alias("curie"))


def prefixed(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows joined to every prefix they start with. Lengths of prefixes are few, so each row is looked up once for each length."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    cut = F.array_distinct(F.array(*[F.when(F.length(column) >= n, F.substring(column, 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    keyed = rows.withColumn("__key", F.explode(F.array_compact(cut)))
    return keyed.join(prefixes, F.col("__key") == F.col(prefix)).drop("__key")


def longest_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str, value: str) -> DataFrame:
    """(column, prefix, value): of each distinct string, the longest prefix it starts with; strings without one are left out."""
    met = prefixed(rows.select(column).distinct(), column, prefixes, prefix)
    best = met.groupBy(column).agg(F.max_by(F.struct(prefix, value), F.struct(F.length(prefix), F.col(value))).alias("b"))
    return best.select(column, f"b.{prefix}", f"b.{value}")


def url_to_curie(rows: DataFrame, column: str, registry: DataFrame) -> DataFrame:
    """(column, curie): the longest registered URI prefix, replaced."""
    best = longest_prefix(rows, column, registry, "uri_prefix", "prefix")
    return best.select(column, F.concat("prefix", F.lit(":"), F.substr(F.col(column), F.length("uri_prefix") + 1)).alias("curie"))


def curie_to_url(rows: DataFrame, column: str, registry: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """(column, url, source) of CURIEs: by a database's URL pattern (database, url_syntax) first, else by the registry.

    The registry's pattern must fit the whole local part; a prefix without a pattern gives no URL. ``uri_format`` holds the place
    of the local part as ``$1``; a registry with only ``uri_prefix`` puts it at the end.
    """
    database, local = F.substring_index(column, ":", 1), F.substring(F.col(column), F.instr(F.col(column), ":") + 1, F.length(column))
    keyed = rows.select(column, text.normal_prefix(database).alias("__key"), F.lower(database).alias("__db"), local.alias("__local")).where(F.col(column).contains(":")).distinct()
    form = F.col("uri_format") if "uri_format" in registry.columns else F.concat("uri_prefix", F.lit("$1"))
    known = registry.select(text.normal_prefix(F.col("prefix")).alias("__key"), "pattern", form.alias("__form"))
    found = keyed.join(known, "__key").where(F.expr("__form is not null and __local rlike concat('^(?:', pattern, ')$')"))
    found = found.select(column, F.replace("__form", F.lit("$1"), F.col("__local")).alias("url"), F.lit("registry").alias("source"), F.lit(2).alias("__rank"))
    if databases is not None:
        own = keyed.join(databases.select(F.col("database").alias("__db"), "url_syntax"), "__db")
        found = found.union(own.select(column, F.replace("url_syntax", F.lit("[example_id]"), F.col("__local")).alias("url"), F.lit("databases").alias("source"), F.lit(1).alias("__rank")))
    return found.groupBy(column).agg(F.min(F.struct("__rank", "url", "source")).alias("b")).select(column, "b.url", "b.source")


def import_pairs(entities: DataFrame, definers: DataFrame) -> DataFrame:
    """(ontology_id, imports_from): an ontology that has an IRI without defining it imports from those that define it."""
    users = entities.select("iri", F.col("ontology_id").alias("user")).distinct()
    users = users.join(definers.select("iri", F.col("ontology_id").alias("user")), ["iri", "user"], "left_anti")
    return users.join(definers, "iri").select(F.col("user").alias("ontology_id"), F.col("ontology_id").alias("imports_from")).distinct()


def unified_curies(entities: DataFrame, definers: DataFrame) -> DataFrame:
    """(iri, curie, short_form): one for all copies of an IRI: a definer's, with a colon if any has one, the first ontology's."""
    mark = definers.select("iri", "ontology_id", F.lit(True).alias("d"))
    rows = entities.join(mark, ["iri", "ontology_id"], "left")
    order = F.struct(F.when(F.col("d"), 0).otherwise(1), F.when(F.col("curie").contains(":"), 0).otherwise(1), F.col("ontology_id"), F.col("curie"))
    best = rows.groupBy("iri").agg(F.min_by("curie", order).alias("curie"))
    return best.select("iri", "curie", F.replace("curie", F.lit(":"), F.lit("_")).alias("short_form"))


def gathered(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, s): the CURIE-like and IRI-like parts of a text, each once."""
    value = F.col(column)
    return df.where(value.isNotNull()).select(F.col(key), F.explode(F.array_distinct(references(value))).alias("s"))


def references(value: Column) -> Column:
    """The CURIE-like and IRI-like parts of a text, as an array."""
    return F.concat(F.regexp_extract_all(value, F.lit(r"[A-Z]+:[0-9A-z]+"), F.lit(0)), F.regexp_extract_all(value, F.lit(r"[A-z]+://\S+"), F.lit(0)))


def gathered_values(props: DataFrame) -> DataFrame:
    """(ontology_id, s): all that values of an ontology may refer to: predicates, whole values, and the CURIE-like and IRI-like parts of texts."""
    rows = props.where((F.col("kind") != "bnode") & F.col("value").isNotNull())
    whole = rows.select("ontology_id", F.col("value").alias("s"))
    parts = gathered(rows.select("ontology_id", "value").distinct(), "ontology_id", "value")
    plain = F.regexp_replace("predicate", r"^[A-z]+\+(.+)$", "$1")
    return whole.union(parts).union(props.select("ontology_id", plain)).distinct()


def by_precedence(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order, combined before the shuffle."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("__key")).agg(best.alias("b")).select("b.*")


def stated_definers(props: DataFrame, ontologies: DataFrame) -> DataFrame:
    """(iri, ontology_id): an entity's isDefinedBy values that are IRIs of known ontologies (iri, ontology_id)."""
    stated = props.where(F.col("predicate") == V.RDFS + "isDefinedBy").select(F.col("id").alias("iri"), F.col("value").alias("__of"))
    return stated.join(ontologies.select(F.col("iri").alias("__of"), "ontology_id"), "__of").select("iri", "ontology_id").distinct()


def repaired_curies(entities: DataFrame, definers: DataFrame) -> DataFrame:
    """``entities`` where a curie without a colon gives way to that of the first defining ontology that has one with a colon."""
    whole = entities.where(F.col("curie").contains(":")).join(definers.select("iri", "ontology_id").distinct(), ["iri", "ontology_id"], "left_semi")
    best = whole.groupBy("iri").agg(F.min_by("curie", F.struct("ontology_id", "curie")).alias("__curie"))
    out = entities.join(best, "iri", "left")
    return out.withColumn("curie", F.when(F.col("curie").contains(":"), F.col("curie")).otherwise(F.coalesce("__curie", "curie"))).select(*entities.columns)


def payloads(uses: DataFrame, entities: DataFrame, definers: DataFrame) -> DataFrame:
    """(ontology_id, iri, defined_by, num_appears_in, has_local_definition, label, curie, types) of IRIs that an ontology mentions.

    ``uses`` holds ontology_id and iri; IRIs of no entity are left out. Label, curie and types come from the first defining ontology, else
    the ontology's own copy, else the first ontology's. An IRI that one ontology alone has is defined by it; else, without a definer, by none.
    """
    each = entities.groupBy("iri", "ontology_id").agg(F.min("label").alias("label"), F.min("curie").alias("curie"), F.array_sort(F.collect_set("type")).alias("types"))
    marks = definers.select("iri", "ontology_id").distinct().withColumn("defines", F.lit(True))
    each = each.join(marks, ["iri", "ontology_id"], "left")
    shown = F.struct("label", "curie", "types")
    by = F.when(F.col("defines"), F.col("ontology_id"))
    whole = each.groupBy("iri").agg(
        F.array_sort(F.collect_set(by)).alias("definers"), F.array_sort(F.collect_set("ontology_id")).alias("holders"), F.sum(F.size("types")).alias("num_appears_in"),
        F.min_by(F.when(F.col("defines"), shown), by).alias("defining"), F.min_by(shown, "ontology_id").alias("any"),
    )
    own = each.select("iri", "ontology_id", shown.alias("own"))
    met = uses.select("ontology_id", "iri").distinct().join(whole, "iri").join(own, ["iri", "ontology_id"], "left")
    out = met.withColumn("shown", F.coalesce("defining", "own", "any"))
    defined_by = F.when(F.size("definers") > 0, F.col("definers")).when(F.size("holders") == 1, F.col("holders"))
    return out.select("ontology_id", "iri", defined_by.alias("defined_by"), "num_appears_in", F.col("own").isNotNull().alias("has_local_definition"), "shown.*")


def linked_entities(strings: DataFrame, entities: DataFrame, definers: DataFrame, registry: DataFrame, bases: DataFrame, databases: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(ontology_id, s, iri, …, url, source): what each string (ontology_id, s) of an ontology refers to, with the columns of ``payloads``.

    Blank strings and the rdf and owl namespaces refer to nothing. A string is an entity's IRI; else a URL under a registered prefix
    (``registry`` with database, uri_prefix) or a CURIE, which names an entity under an ontology's ``bases`` (prefix, base), or has a URL, or
    both; else a key of ``links`` (key, source, url, label). Strings that are none of these have no row.
    """
    todo = strings.select("ontology_id", "s").where(F.length(F.trim("s")) > 0).where(~F.col("s").startswith(V.RDF) & ~F.col("s").startswith(V.OWL)).distinct()
    iris = entities.select(F.col("iri").alias("s")).distinct()
    direct = todo.join(iris, "s", "left_semi").select("ontology_id", "s", F.col("s").alias("iri"))
    rest = todo.join(iris, "s", "left_anti")
    curies = url_to_curie(rest, "s", registry).withColumn("rank", F.lit(1)).union(rest.where(text.looks_like_curie(F.col("s"))).select("s", F.col("s").alias("curie"), F.lit(2).alias("rank")))
    curies = curies.groupBy("s").agg(F.min_by("curie", F.struct("rank", "curie")).alias("c"))
    split = curies.select("s", "c", F.substring_index("c", ":", 1).alias("prefix"), F.expr("substring(c, instr(c, ':') + 1)").alias("local"))
    named = split.join(bases, "prefix").select("s", F.concat("base", "local").alias("iri")).join(entities.select("iri").distinct(), "iri", "left_semi").groupBy("s").agg(F.min("iri").alias("iri"))
    urls = curie_to_url(curies.select("c"), "c", registry, databases)
    with_urls = split.join(urls, "c", "left").join(named, "s", "left").where("iri is not null or url is not null").select("s", "iri", "c", "url", "source")
    by_curie = rest.join(with_urls, "s").select("ontology_id", "s", "iri", F.when(F.col("url").isNotNull(), F.col("c")).alias("c"), "url", "source", F.lit(None).cast("string").alias("l"))
    none = [F.lit(None).cast("string").alias(n) for n in ("c", "url", "source", "l")]
    found = direct.select("ontology_id", "s", "iri", *none).union(by_curie)
    if links is not None:
        other = rest.join(with_urls.select("s"), "s", "left_anti").join(links.withColumnRenamed("key", "s"), "s")
        found = found.union(other.select("ontology_id", "s", F.lit(None).cast("string").alias("iri"), F.lit(None).cast("string").alias("c"), "url", "source", F.col("label").alias("l")))
    told = payloads(found.where("iri is not null"), entities, definers)
    out = found.join(told, ["ontology_id", "iri"], "left")
    return out.select("ontology_id", "s", "iri", "defined_by", "num_appears_in", "has_local_definition", F.coalesce("label", "l").alias("label"), F.coalesce("c", "curie").alias("curie"), "types", "url", "source")
