"""Mapping sets: cross references of entities as pairs of CURIEs, a set of prefixes for each ontology, and files that hold both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions import vocabulary as V
from ontoloom.plans.spread import spread_join
from ontoloom.plans.staging import staged

KEY = ["ontology_id", "id"]
#: Predicates that map, properties whose value is itself the object under a prefix, and prefixes that every set has.
PREDICATES = {V.SKOS + "exactMatch": "skos:exactMatch", V.OIO + "hasDbXref": "oboInOwl:hasDbXref", V.OWL + "equivalentClass": "owl:equivalentClass"}
STRUCTURES = {V.OBO + "chebi/" + name: name for name in ("inchi", "inchikey", "smiles")}
STRUCTURE_PREDICATE, JUSTIFICATION = "oboInOwl:hasDbXref", "semapv:UnspecifiedMatching"
PREFIXES = {"owl": V.OWL, "skos": V.SKOS, "oboInOwl": V.OIO, "chebi": V.OBO + "chebi/"} | {name: f"https://bioregistry.io/{name}:" for name in STRUCTURES.values()}
COLUMNS = ("subject_id", "predicate_id", "object_id", "mapping_justification", "subject_label", "object_label")
#: Rows of a file of mappings, about.
FILE_ROWS = 1_000_000


def allocated_prefixes(uses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, prefix, namespace, name, n): the prefix that stands for each (prefix, namespace) of ``uses``, and how often it is used.

    The namespace that a prefix has first (column ``seen``) keeps it. Any other goes by a prefix that has this namespace first, if there is one;
    else it gets the prefix with _2, _3 … in order of first use, past names that are prefixes themselves, and uses under other prefixes share that name.
    """
    each = uses.groupBy(*keys, "prefix", "namespace").agg(F.min("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    ranked = staged(each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "prefix").orderBy("seen", "namespace"))), "prefixes")
    owned = ranked.where("rank = 1")
    owners = owned.groupBy(*keys, "namespace").agg(F.min_by("prefix", F.struct("seen", "prefix")).alias("owner"))
    homeless = ranked.where("rank > 1").join(owners, [*keys, "namespace"], "left_anti")
    first = homeless.groupBy(*keys, "namespace").agg(F.min(F.struct("seen", "prefix")).alias("f")).select(*keys, "namespace", F.col("f.prefix").alias("base"), "f.seen")
    nth = first.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "base").orderBy("seen", "namespace")))
    number = F.regexp_extract("prefix", r"^.+_([1-9]\d{0,8})$", 1)
    taken = owned.where(number != "").groupBy(*keys, F.regexp_extract("prefix", r"^(.+)_\d+$", 1).alias("base")).agg(F.collect_set(number.cast("int")).alias("taken"))
    held = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(2), F.lit(1) + F.col("nth") + F.size(held)), held)
    given = nth.join(taken, [*keys, "base"], "left").select(*keys, "namespace", F.concat("base", F.lit("_"), F.element_at(free, F.col("nth")).cast("string")).alias("given"))
    out = ranked.join(owners, [*keys, "namespace"], "left").join(given, [*keys, "namespace"], "left")
    return out.select(*keys, "prefix", "namespace", F.when(F.col("rank") == 1, F.col("prefix")).otherwise(F.coalesce("owner", "given")).alias("name"), "n")


def _parts(curie: Column, at: Column) -> Column:
    """(prefix, namespace, local, at) of a thing with an address and perhaps a curie; null where the two do not fit.

    The address must end with the curie's local part, what stands before it is the namespace. A curie without a colon fits nothing.
    """
    pieces = F.split(curie, ":")
    prefix, local = F.try_element_at(pieces, F.lit(1)), F.try_element_at(pieces, F.lit(2))
    fits = (prefix != "") & (local != "") & F.endswith(at, local)
    namespace = F.substring(at, F.lit(1), F.length(at) - F.length(local))
    none = F.lit(None).cast("string")
    whole = F.struct(prefix.alias("prefix"), namespace.alias("namespace"), local.alias("local"), at.alias("at"))
    bare = F.struct(none.alias("prefix"), none.alias("namespace"), none.alias("local"), at.alias("at"))
    return F.when(curie.isNull() & at.isNotNull(), bare).when(fits, whole)


def mappings(values: DataFrame, subjects: DataFrame, linked: DataFrame, predicates: dict[str, str] = PREDICATES, structures: dict[str, str] = STRUCTURES, prefixes: dict[str, str] = PREFIXES) -> tuple[DataFrame, DataFrame]:
    """(ontology_id, *COLUMNS) rows, and (ontology_id, prefix, namespace) of the prefixes that each ontology's rows use.

    ``values`` holds ontology_id, id, predicate, value; ``subjects`` the entities that map (ontology_id, id, label, curie), so imported ones are left out
    beforehand; ``linked`` what a value refers to (ontology_id, s, iri, url, curie, label), once. A value that refers to nothing, and a thing
    whose curie does not fit its address, map nothing; a thing without a curie goes by its address. Repeated rows and null values give one row and none.
    """
    names = F.create_map(*[F.lit(x) for pair in predicates.items() for x in pair]) if predicates else F.create_map().cast("map<string,string>")
    rows = values.where(F.col("predicate").isin(*predicates, *structures) & F.col("value").isNotNull()).select(*KEY, "predicate", "value").distinct()
    things = subjects.groupBy(*KEY).agg(F.min(F.struct("label", "curie")).alias("o")).select(*KEY, F.col("o.label").alias("subject_label"), _parts(F.col("o.curie"), F.col("id")).alias("a"))
    rows = rows.join(things.where("a is not null"), KEY)
    met = rows.where(F.col("predicate").isin(*predicates)).join(linked.withColumnRenamed("s", "value").select("ontology_id", "value", "label", _parts(F.col("curie"), F.coalesce("iri", "url")).alias("b")).where("b is not null"), ["ontology_id", "value"])
    none = F.lit(None).cast("string")
    found = met.select("ontology_id", "id", "a", "subject_label", names[F.col("predicate")].alias("predicate_id"), "b", F.col("label").alias("object_label"))
    if structures:
        of = F.create_map(*[F.lit(x) for pair in structures.items() for x in pair])[F.col("predicate")]
        whole = F.struct(none.alias("prefix"), none.alias("namespace"), none.alias("local"), F.concat(of, F.lit(":"), "value").alias("at"))
        found = found.union(rows.where(F.col("predicate").isin(*structures)).select("ontology_id", "id", "a", "subject_label", F.lit(STRUCTURE_PREDICATE), whole, "value"))
    found = staged(found, "mappings")
    # prefixes are taken in order of subjects, a subject's own before those of its objects
    use = lambda side, n: found.where(f"{side}.prefix is not null").select("ontology_id", f"{side}.prefix", f"{side}.namespace", F.struct(F.col("id").alias("id"), F.lit(n).alias("side"), F.col(f"{side}.at").alias("at")).alias("seen"))
    uses = use("a", 0).union(use("b", 1))
    if prefixes:
        fixed = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(ns).alias("namespace")) for p, ns in prefixes.items()]))
        start = found.select("ontology_id").distinct().select("ontology_id", fixed.alias("f")).select("ontology_id", "f.prefix", "f.namespace", F.struct(F.lit("").alias("id"), F.lit(0).alias("side"), F.lit("").alias("at")).alias("seen"))
        uses = uses.union(start)
    table = staged(allocated_prefixes(uses, ("ontology_id",)), "names")
    out = found
    for side, name in (("a", "subject_id"), ("b", "object_id")):
        keyed = out.withColumns({"prefix": F.coalesce(f"{side}.prefix", F.lit("")), "namespace": F.coalesce(f"{side}.namespace", F.lit(""))})
        out = spread_join(keyed, table, ["ontology_id", "prefix", "namespace"], ["id", f"{side}.at"], "left")
        out = out.withColumn(name, F.coalesce(F.concat("name", F.lit(":"), f"{side}.local"), f"{side}.at")).drop("name", "prefix", "namespace")
    rows = out.withColumn("mapping_justification", F.lit(JUSTIFICATION)).select("ontology_id", *COLUMNS)
    return rows, table.select("ontology_id", F.col("name").alias("prefix"), "namespace").distinct()


def header(prefixes: DataFrame, base: str) -> DataFrame:
    """(ontology_id, line): the comment lines before each ontology's mappings, the set's id and its prefixes by name, in one text."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    lines = F.array_sort(F.collect_list(F.concat(F.lit("#   "), "prefix", F.lit(": "), quoted(F.col("namespace")))))
    top = F.concat(F.lit("# mapping_set_id: "), quoted(F.concat(F.lit(base), F.col("ontology_id"), F.lit(".sssom.tsv"))), F.lit("\n# curie_map:\n"))
    return prefixes.groupBy("ontology_id").agg(lines.alias("lines")).select("ontology_id", F.concat(top, F.array_join("lines", "\n"), F.lit("\n" + "\t".join(COLUMNS))).alias("line"))


def write(rows: DataFrame, prefixes: DataFrame, path: str, base: str = "", file_rows: int = FILE_ROWS) -> None:
    """Tab-separated files under ``path``/ontology_id=…/part=…, each whole in itself: the header, the names of columns, then mappings.

    An ontology has one file for each ``file_rows`` of its rows, dealt by a hash, so a large set passes through many tasks.
    """
    files = rows.groupBy("ontology_id").agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("files"))
    line = F.to_csv(F.struct(*COLUMNS), {"sep": "\t"})
    part = F.pmod(F.xxhash64(*COLUMNS), F.col("files")).cast("int")
    dealt = rows.join(F.broadcast(files), "ontology_id") if files.count() <= 100_000 else rows.join(files, "ontology_id")
    body = dealt.select("ontology_id", part.alias("part"), F.lit(1).alias("rank"), line.alias("line"))
    head = header(prefixes, base).join(files, "ontology_id").select("ontology_id", F.explode(F.sequence(F.lit(0), F.col("files") - 1)).alias("part"), F.lit(0).alias("rank"), "line")
    ordered = head.union(body).repartition("ontology_id", "part").sortWithinPartitions("ontology_id", "part", "rank", "line")
    ordered.select("line", "ontology_id", "part").write.partitionBy("ontology_id", "part").text(path)
