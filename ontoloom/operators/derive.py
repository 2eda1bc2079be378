"""Derived properties of ontology nodes.

Frames: ``triples`` as the RDF source gives them; ``nodes`` (ontology_id, id, bnode, types, imported); ``props`` (ontology_id, id, predicate, pos,
kind, value, datatype, lang), one row for each distinct value in first-seen order. Each derivation takes such frames and returns rows of the same
shape as ``props`` or a narrow frame of its own; all are joins and aggregates on (ontology_id, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions import text, vocabulary as V
from ontoloom.operators.closure import closure, list_positions
from ontoloom.operators.reach import strong_components
from ontoloom.plans.staging import staged

KEY = ["ontology_id", "id"]
VALUE = ["kind", "value", "datatype", "lang"]


def node_table(triples: DataFrame) -> DataFrame:
    """(ontology_id, id, bnode, types, imported): every subject; imported when only imports mention it."""
    kinds = F.create_map(*[x for iri, types in V.NODE_TYPES.items() for x in (F.lit(iri), F.array(*map(F.lit, types)))])
    own = F.when((F.col("p") == V.TYPE) & (F.col("o_kind") == "uri"), F.try_element_at(kinds, F.col("o")))
    listed = F.when(F.col("p").isin(V.FIRST, V.REST) & (F.col("o_kind") != "literal"), F.array(F.lit("rdfList")))
    rows = triples.select("ontology_id", F.col("s").alias("id"), F.col("s_bnode").alias("bnode"), "file_rank", F.explode_outer(F.coalesce(own, listed)).alias("t"))
    return rows.groupBy(*KEY).agg(F.max("bnode").alias("bnode"), F.array_sort(F.collect_set("t")).alias("types"), (F.min("file_rank") > 0).alias("imported"))


def prop_table(triples: DataFrame) -> DataFrame:
    """Distinct values of each node and predicate, pos in first-seen order."""
    value = [F.col("o_kind").alias("kind"), F.col("o").alias("value"), "datatype", "lang"]
    seen = triples.select("ontology_id", F.col("s").alias("id"), F.col("p").alias("predicate"), *value, F.struct("file_rank", "seq").alias("at"))
    first = seen.groupBy(*KEY, "predicate", *VALUE).agg(F.min("at").alias("at"))
    pos = F.row_number().over(Window.partitionBy(*KEY, "predicate").orderBy("at")) - 1
    return first.select(*KEY, "predicate", pos.alias("pos"), *VALUE)


def counters(triples: DataFrame) -> DataFrame:
    """(ontology_id, classes, properties, individuals, entities, languages): type triples with a named subject, as often as stated."""
    kinds = F.create_map(*[x for iri, types in V.NODE_TYPES.items() if set(types) & set(V.ENTITY_TYPES) for x in (F.lit(iri), F.lit(types[-1]))])
    kind = F.when((F.col("p") == V.TYPE) & ~F.col("s_bnode"), F.try_element_at(kinds, F.col("o")))
    n = {k: F.count_if(kind == k) for k in V.ENTITY_TYPES}
    langs = F.array_sort(F.array_union(F.array(F.lit("en")), F.collect_set(F.when(F.col("lang") != "", F.col("lang")))))
    out = triples.groupBy("ontology_id").agg(*[c.alias(k) for k, c in n.items()], langs.alias("languages"))
    return out.select("ontology_id", F.col("class").alias("classes"), F.col("property").alias("properties"), F.col("individual").alias("individuals"), (F.col("class") + F.col("property") + F.col("individual")).alias("entities"), "languages")


def _is(kind: str) -> Column:
    return F.array_contains("types", kind)


def _of(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(reduce(Column.__or__, map(_is, kinds))).select(*KEY, "types", "bnode")


def searchable_values(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """(…, value): literals of entities and ontologies outside the rdf, rdfs and owl namespaces."""
    free = props.where((F.col("kind") == "literal") & ~reduce(Column.__or__, [F.col("predicate").startswith(n) for n in (V.RDF, V.RDFS, V.OWL)]))
    return free.join(_of(nodes, *V.ENTITY_TYPES, "ontology"), KEY, "left_semi").select(*KEY, "value").distinct()


def symmetric(nodes: DataFrame, props: DataFrame, predicate: str, kind: str) -> DataFrame:
    """(…, value): both directions of a stated relation whose target is a node."""
    stated = props.where((F.col("predicate") == predicate) & (F.col("kind") == "uri")).join(_of(nodes, kind), KEY, "left_semi").select("ontology_id", "id", "value")
    known = nodes.select("ontology_id", F.col("id").alias("value"))
    stated = stated.join(known, ["ontology_id", "value"], "left_semi").select("ontology_id", "id", "value")
    return stated.union(stated.select("ontology_id", F.col("value").alias("id"), F.col("id").alias("value"))).distinct()


def equivalents(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Symmetric, not transitive: equivalentClass of classes, equivalentProperty of what is a property only."""
    only = nodes.where(~_is("class"))
    a, b = symmetric(nodes, props, V.OWL + "equivalentClass", "class"), symmetric(only, props, V.OWL + "equivalentProperty", "property")
    return a.union(b)


def direct_parents(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """(…, parent): named and present. Classes by subClassOf, else properties by subPropertyOf, else individuals by their types."""
    rule = F.when(_is("class"), V.SUBCLASS).when(_is("property"), V.SUBPROPERTY).when(_is("individual"), V.TYPE)
    own = nodes.where(~F.col("bnode")).select(*KEY, rule.alias("predicate")).where("predicate is not null")
    up = props.where(F.col("kind") == "uri").join(own, [*KEY, "predicate"], "left_semi").where(~((F.col("predicate") == V.TYPE) & (F.col("value") == V.NAMED_INDIVIDUAL)))
    known = nodes.select("ontology_id", F.col("id").alias("value"))
    return up.join(known, ["ontology_id", "value"], "left_semi").select(*KEY, F.col("value").alias("parent")).distinct()


def _first(props: DataFrame, predicate: str, name: str) -> DataFrame:
    return props.where(F.col("predicate") == predicate).groupBy(*KEY).agg(F.min_by(F.struct("value", "kind"), "pos").alias(name))


def list_members(props: DataFrame) -> DataFrame:
    """(ontology_id, list, pos, member, kind): members of rdf lists in order, by pointer doubling over the cells."""
    cells = props.where(F.col("predicate") == V.FIRST)
    mark = lambda c: F.concat_ws(" ", "ontology_id", c)
    rest = props.where((F.col("predicate") == V.REST) & (F.col("value") != V.NIL)).select(*KEY, F.col("value").alias("rest"))
    all_cells = cells.select(*KEY).distinct().join(rest, KEY, "left")
    placed = list_positions(all_cells.select(mark("id").alias("id"), mark("rest").alias("rest")).withColumn("rest", F.when(F.col("rest").contains(" "), F.col("rest"))))
    first = cells.where("pos = 0").select(mark("id").alias("id"), "ontology_id", F.col("value").alias("member"), "kind")
    return placed.join(first, "id").select("ontology_id", F.substring_index("head", " ", -1).alias("list"), "pos", "member", "kind")


def flat_lists(props: DataFrame) -> DataFrame:
    """``props`` with the members of a list as values of its head under an empty predicate, in place of its cells."""
    none = F.lit(None).cast("string")
    cells = props.where(F.col("predicate").isin(V.FIRST, V.REST)).select(*KEY).distinct()
    items = list_members(props).select("ontology_id", F.col("list").alias("id"), F.lit("").alias("predicate"), F.col("pos").cast("long").alias("pos"), "kind", F.col("member").alias("value"), none.alias("datatype"), none.alias("lang"))
    return props.select(*KEY, "predicate", F.col("pos").cast("long").alias("pos"), *VALUE).join(cells, KEY, "left_anti").union(items)


def related(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """(…, property, value, expression): what anonymous superclasses of named classes relate them to.

    someValuesFrom a named node; members of oneOf and named members of intersectionOf, bare or as a filler; hasValue of an individual,
    which is recorded from the individual to the class. Union, complement, universal and counted restrictions relate nothing.
    """
    classes = nodes.where(_is("class") & ~F.col("bnode")).select(*KEY)
    anon = props.where((F.col("predicate") == V.SUBCLASS) & (F.col("kind") == "bnode")).join(classes, KEY, "left_semi").select("ontology_id", F.col("id").alias("cls"), F.col("value").alias("id"))
    for p in ("onProperty", "someValuesFrom", "hasValue", "oneOf", "intersectionOf"):
        anon = anon.join(_first(props, V.OWL + p, p), KEY, "left")
    lists = list_members(props).select("ontology_id", F.col("list").alias("l"), "member", F.col("kind").alias("member_kind"))
    inner = props.where(F.col("predicate").isin(V.OWL + "oneOf", V.OWL + "intersectionOf") & (F.col("pos") == 0)).groupBy(*KEY).agg(F.min_by(F.struct("predicate", "value"), F.when(F.col("predicate") == V.OWL + "oneOf", 0).otherwise(1)).alias("x"))
    inner = inner.select("ontology_id", F.col("id").alias("filler"), F.col("x.predicate").alias("inner_p"), F.col("x.value").alias("inner_list"))
    named = F.col("onProperty.kind") == "uri"
    bare = anon.where(F.col("onProperty").isNull())
    bare = bare.select("ontology_id", "cls", F.lit(V.SUBCLASS).alias("property"), F.coalesce("oneOf.value", "intersectionOf.value").alias("l"), F.col("oneOf").isNull().alias("named_only"), F.col("id").alias("expression"))
    filled = anon.where(named & (F.col("someValuesFrom.kind") == "bnode")).select("ontology_id", "cls", F.col("onProperty.value").alias("property"), F.col("someValuesFrom.value").alias("filler")).join(inner, ["ontology_id", "filler"])
    filled = filled.select("ontology_id", "cls", "property", F.col("inner_list").alias("l"), (F.col("inner_p") != V.OWL + "oneOf").alias("named_only"), F.col("inner_list").alias("expression"))
    members = bare.union(filled).join(lists, ["ontology_id", "l"]).where(~F.col("named_only") | (F.col("member_kind") == "uri"))
    by_list = members.select("ontology_id", F.col("cls").alias("id"), "property", F.col("member").alias("value"), "expression")
    known = nodes.where(~F.col("bnode")).select("ontology_id", F.col("id").alias("value"), _is("individual").alias("individual"))
    some = anon.where(named & (F.col("someValuesFrom.kind") == "uri") & (F.col("someValuesFrom.value") != F.col("cls"))).select("ontology_id", F.col("cls").alias("id"), F.col("onProperty.value").alias("property"), F.col("someValuesFrom.value").alias("value"), F.col("id").alias("expression"))
    some = some.join(known, ["ontology_id", "value"], "left_semi").select(*by_list.columns)
    held = anon.where(named & F.col("someValuesFrom").isNull() & (F.col("hasValue.kind") == "uri")).select("ontology_id", F.col("cls").alias("value"), F.col("onProperty.value").alias("property"), F.col("hasValue.value").alias("id"), F.col("id").alias("expression"))
    individuals = known.where("individual").select("ontology_id", F.col("value").alias("id"))
    held = held.join(individuals, KEY, "left_semi").select(*by_list.columns)
    return by_list.union(some).union(held).distinct()


def hierarchical_parents(nodes: DataFrame, props: DataFrame, relations: DataFrame, extra: tuple[str, ...] | DataFrame = (V.PART_OF,)) -> DataFrame:
    """(…, parent, relation, inverse): named superclasses, and what hierarchical properties (``extra``, as in ``collated``) relate a class to."""
    known = nodes.select("ontology_id", F.col("id").alias("parent"))
    direct = props.where((F.col("predicate") == V.SUBCLASS) & (F.col("kind") == "uri")).join(_of(nodes, "class"), KEY, "left_semi")
    direct = direct.select(*KEY, F.col("value").alias("parent"), F.lit(None).cast("string").alias("relation"))
    by = _under(relations.withColumnRenamed("property", "predicate"), extra).withColumnRenamed("predicate", "property").select(*KEY, F.col("value").alias("parent"), F.col("property").alias("relation"))
    inverse = _first(props, V.OWL + "inverseOf", "i").select("ontology_id", F.col("id").alias("relation"), F.col("i.value").alias("inverse"))
    both = direct.union(by).join(known, ["ontology_id", "parent"], "left_semi")
    return both.join(inverse, ["ontology_id", "relation"], "left").select(*KEY, "parent", "relation", "inverse").distinct()


def ancestors(parents: DataFrame) -> DataFrame:
    """(ontology_id, id, ancestor) over (…, id, parent)."""
    pairs = closure(parents.select("ontology_id", F.col("id").alias("src"), F.col("parent").alias("dst")), keys=("ontology_id",))
    return pairs.select("ontology_id", F.col("src").alias("id"), F.col("dst").alias("ancestor"))


def short_forms(nodes: DataFrame, config: DataFrame) -> DataFrame:
    """(…, short_form, curie) of named entities and datatypes; config: ontology_id, prefix, base_uris."""
    named = nodes.where(~F.col("bnode") & reduce(Column.__or__, map(_is, (*V.ENTITY_TYPES, "datatype"))))
    prefix = F.coalesce("prefix", F.upper("ontology_id"))
    bases = F.array_union(F.coalesce("base_uris", F.array().cast("array<string>")), F.array(F.concat(F.lit(V.OBO), prefix, F.lit("_"))))
    short = text.short_form(F.col("id"), bases, prefix)
    return named.join(config.select("ontology_id", "prefix", "base_uris"), "ontology_id", "left").select(*KEY, short.alias("short_form"), text.curie(short).alias("curie"))


def collated(nodes: DataFrame, props: DataFrame, predicates: tuple[str, ...] | DataFrame, kinds: tuple[str, ...] = V.ENTITY_TYPES) -> DataFrame:
    """(…, pos, kind, value, datatype, lang): values of several predicates as one list, by predicate, then place, each once.

    ``predicates`` are the same for all ontologies, or rows (ontology_id, predicate).
    """
    rows = _under(props, predicates).join(_of(nodes, *kinds), KEY, "left_semi")
    first = rows.groupBy(*KEY, *VALUE).agg(F.min(F.struct("predicate", "pos")).alias("at"))
    return first.select(*KEY, (F.row_number().over(Window.partitionBy(*KEY).orderBy("at")) - 1).alias("pos"), *VALUE)


def _under(props: DataFrame, predicates: tuple[str, ...] | DataFrame) -> DataFrame:
    if isinstance(predicates, DataFrame):
        return props.join(predicates.select("ontology_id", "predicate").distinct(), ["ontology_id", "predicate"], "left_semi")
    return props.where(F.col("predicate").isin(*predicates))


def labels(nodes: DataFrame, props: DataFrame, shorts: DataFrame, predicates: tuple[str, ...] | DataFrame = V.LABELS) -> DataFrame:
    """Collated labels; an entity with no value that is untagged, English or no literal also gets its short form."""
    own = collated(nodes, props, predicates)
    plain = (F.col("kind") != "literal") | (F.coalesce("lang", F.lit("")).isin("", "en"))
    served = own.where(plain).select(*KEY).distinct()
    last = own.groupBy(*KEY).agg((F.max("pos") + 1).alias("pos"))
    lacking = shorts.join(served, KEY, "left_anti").join(_of(nodes, *V.ENTITY_TYPES), KEY, "left_semi").join(last, KEY, "left")
    extra = lacking.select(*KEY, F.coalesce("pos", F.lit(0)).alias("pos"), F.lit("literal").alias("kind"), F.col("short_form").alias("value"), F.lit(V.XSD + "string").alias("datatype"), F.lit("").alias("lang"))
    return own.union(extra)


def used_predicates(nodes: DataFrame, props: DataFrame, predicates: tuple[str, ...] | DataFrame) -> DataFrame:
    """(…, predicate): which of the configured predicates an entity has."""
    return _under(props, predicates).join(_of(nodes, *V.ENTITY_TYPES), KEY, "left_semi").select(*KEY, "predicate").distinct()


def axioms(props: DataFrame) -> DataFrame:
    """(…, id, predicate, kind, value, axiom, annotations) of reified statements: id and predicate are the annotated ones.

    annotations maps each further predicate of the axiom node to its values in order.
    """
    named = {n: F.col("predicate") == V.OWL + p for n, p in (("source", "annotatedSource"), ("prop", "annotatedProperty"), ("target", "annotatedTarget"))}
    parts = [F.min_by(F.when(is_it, F.struct("value", "kind")), F.when(is_it, F.col("pos"))).alias(n) for n, is_it in named.items()]
    other = ~F.col("predicate").isin(V.TYPE, *(V.OWL + p for p in ("annotatedSource", "annotatedProperty", "annotatedTarget")))
    met = props.groupBy(*KEY).agg(*parts, F.sort_array(F.collect_list(F.when(other, F.struct("predicate", "pos", "value")))).alias("rest"))
    met = met.where("source is not null and prop is not null and target is not null")
    own = lambda p: F.transform(F.filter("rest", lambda r: r["predicate"] == p), lambda r: r["value"])
    notes = F.map_from_entries(F.transform(F.array_distinct("rest.predicate"), lambda p: F.struct(p.alias("predicate"), own(p).alias("values"))))
    out = met.withColumn("annotations", F.when(F.size("rest") > 0, notes))
    return out.select("ontology_id", F.col("source.value").alias("id"), F.col("prop.value").alias("predicate"), F.col("target.kind").alias("kind"), F.col("target.value").alias("value"), F.col("id").alias("axiom"), "annotations")


def reified(props: DataFrame, found: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """``props`` with an array ``axioms`` of annotation maps; a target that no value equals is appended as a value of its own.

    Blank nodes are equal where their trees are, by ``canonical`` (``expression_hashes``); without it where their ids are.
    """
    by = [*KEY, "predicate", "kind", "__same"]
    props, found = _with_same(props, canonical), _with_same(found, canonical)
    notes = found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("axiom", F.map_entries("annotations").alias("a")))), lambda x: F.map_from_entries(x["a"])).alias("axioms"), F.min("value").alias("target"))
    met = props.withColumn("__own", F.lit(True)).join(notes, by, "full_outer")
    own = F.col("__own").isNotNull()
    value, pos = F.when(own, F.col("value")).otherwise(F.col("target")), F.when(own, F.col("pos")).otherwise(F.lit(1 << 30))
    return met.select(*KEY, "predicate", pos.alias("pos"), "kind", value.alias("value"), "datatype", "lang", "axioms")


def _with_same(rows: DataFrame, canonical: DataFrame | None) -> DataFrame:
    """With what a value is compared by: a blank node's hash, if it has one, else the value."""
    if canonical is None:
        return rows.withColumn("__same", F.col("value"))
    hashes = canonical.select("ontology_id", F.col("id").alias("value"), F.lit("bnode").alias("kind"), "canonical")
    return rows.join(hashes, ["ontology_id", "kind", "value"], "left").withColumn("__same", F.coalesce("canonical", "value")).drop("canonical")


def synonym_type_names(props: DataFrame) -> DataFrame:
    """(…, name) of axiom nodes: the label of their synonym type."""
    kinds = _first(props, V.OIO + "hasSynonymType", "t").where("t.kind = 'uri'").select("ontology_id", "id", F.col("t.value").alias("type_id"))
    names = _first(props, V.LABEL, "l").select("ontology_id", F.col("id").alias("type_id"), F.col("l.value").alias("name"))
    return kinds.join(names, ["ontology_id", "type_id"]).select(*KEY, "name")


def negative_assertions(props: DataFrame) -> DataFrame:
    """(…, predicate, value): negative property assertions on their source individual; a target individual wins over a target value."""
    parts = [_first(props, V.OWL + p, n) for n, p in (("s", "sourceIndividual"), ("p", "assertionProperty"), ("ti", "targetIndividual"), ("tv", "targetValue"))]
    met = parts[0].join(parts[1], KEY).join(parts[2], KEY, "left").join(parts[3], KEY, "left")
    met = met.where("s.kind = 'uri' and p.kind = 'uri' and (ti is not null or tv is not null)")
    return met.select("ontology_id", F.col("s.value").alias("id"), F.concat(F.lit("negativePropertyAssertion+"), "p.value").alias("predicate"), F.coalesce("ti.value", "tv.value").alias("value"))


def obsolete(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """(…, is_obsolete) of named entities: deprecated as true or 1, or a direct subclass of the obsolete class."""
    flag = (F.col("predicate") == V.DEPRECATED) & (F.col("kind") == "literal") & F.lower("value").isin("true", "1")
    flag = flag | ((F.col("predicate") == V.SUBCLASS) & (F.col("value") == V.OBSOLETE_CLASS))
    marked = props.where(flag).select(*KEY).distinct().withColumn("m", F.lit(True))
    return _of(nodes, *V.ENTITY_TYPES).where(~F.col("bnode")).join(marked, KEY, "left").select(*KEY, F.coalesce("m", F.lit(False)).alias("is_obsolete"))


def preferred_roots(nodes: DataFrame, props: DataFrame, config: DataFrame, predicates: tuple[str, ...] = V.PREFERRED_ROOT) -> DataFrame:
    """(…, is_preferred_root) of classes and properties: named by the config (ontology_id, preferred_root_term) or by the ontology node."""
    stated = props.where(F.col("predicate").isin(*predicates) & (F.col("kind") == "uri")).join(_of(nodes, "ontology"), KEY, "left_semi").select("ontology_id", F.col("value").alias("id"))
    wanted = stated.union(config.select("ontology_id", F.explode("preferred_root_term").alias("id"))).distinct().withColumn("w", F.lit(True))
    return _of(nodes, "class", "property").join(wanted, KEY, "left").select(*KEY, F.coalesce("w", F.lit(False)).alias("is_preferred_root"))


def pairwise(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """(…, predicate, value): ordered pairs of the members of each all-disjoint and all-different list, a pair of equal members excepted.

    A list's pairs number the square of its members, as the statement asks; lists are bounded by what one axiom names.
    """
    rules = (("allDisjointClasses", "members", "disjointWith"), ("allDisjointProperties", "members", "propertyDisjointWith"), ("allDifferent", "distinctMembers", "differentFrom"))
    lists = list_members(props)
    found = []
    for kind, by, name in rules:
        heads = _first(props, V.OWL + by, "h").join(_of(nodes, kind), KEY, "left_semi").select("ontology_id", F.col("h.value").alias("list"))
        own = lists.where("kind = 'uri'").join(heads, ["ontology_id", "list"], "left_semi")
        other = own.select("ontology_id", "list", F.col("member").alias("value"))
        pairs = own.join(other, ["ontology_id", "list"]).where("member <> value")
        found.append(pairs.select("ontology_id", F.col("member").alias("id"), F.lit(V.OWL + name).alias("predicate"), "value"))
    return reduce(DataFrame.union, found).distinct()


def has_individuals(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Classes that some individual names as its type."""
    typed = props.where((F.col("predicate") == V.TYPE) & (F.col("kind") == "uri")).join(_of(nodes, "individual"), KEY, "left_semi")
    return _of(nodes, "class").join(typed.select("ontology_id", F.col("value").alias("id")), KEY, "left_semi").select(*KEY)


def expression_hashes(props: DataFrame) -> DataFrame:
    """(…, canonical): a hash of what hangs from each blank node, equal for graphs of equal shape and values, whatever their nodes' names.

    Bottom-up: a node is hashed once all blank nodes it names are, a list as a whole. What is left then is on or above cycles; a set of nodes that
    reach each other, and reach no other unhashed ones, is hashed by refinement (``_hashed_cycles``), and what is above it goes on bottom-up.
    """
    own = staged(flat_lists(props).where(F.col("id").startswith("_:")), "expressions")
    done, comps = _ready(own, None), None
    while True:
        done = _bottom_up(own, done)
        left = own.join(done, KEY, "left_anti")
        if left.isEmpty():
            return done
        if comps is None:  # the same throughout: what is hashed takes no part in a cycle of the rest
            mark = lambda c: F.concat_ws(" ", "ontology_id", c)
            found = strong_components(left.where("kind = 'bnode'").select(mark("id").alias("src"), mark("value").alias("dst")))
            loops = left.where("kind = 'bnode' and id = value").select("ontology_id", "id").distinct()
            split = found.select(F.substring_index("id", " ", 1).alias("ontology_id"), F.substring_index("id", " ", -1).alias("id"), "comp")
            alone = loops.join(split, KEY, "left_anti").select(*KEY, mark("id").alias("comp"))
            comps = staged(split.union(alone), "cycles")
        new = _hashed_cycles(own, done, comps)
        if new.isEmpty():  # what names blank nodes of no statements
            return done
        done = staged(done.union(new), "canonical")


def _named(own: DataFrame, done: DataFrame | None) -> DataFrame:
    """Statements with ``canonical``: the value itself, of a blank node its hash, null where it has none yet. A blank node without statements counts by that alone."""
    if done is None:
        return own.withColumn("canonical", F.when(F.col("kind") != "bnode", F.col("value")))
    names = done.select("ontology_id", F.col("id").alias("value"), "canonical")
    rows = own.join(names, ["ontology_id", "value"], "left")
    return rows.withColumn("canonical", F.when(F.col("kind") == "bnode", F.col("canonical")).otherwise(F.col("value")))


def _hash_of(rows: DataFrame) -> DataFrame:
    line = F.struct("predicate", "pos", F.when(F.col("kind") == "bnode", "bnode").otherwise(F.col("kind")).alias("k"), "canonical", "datatype", "lang")
    return rows.groupBy(*KEY).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(line))), 256).alias("canonical"))


def _ready(own: DataFrame, done: DataFrame | None) -> DataFrame:
    """Hashes of the nodes that are not done and whose blank nodes all are."""
    rest = _named(own if done is None else own.join(done, KEY, "left_anti"), done)
    return staged(_hash_of(rest.join(rest.where("canonical is null and kind = 'bnode'").select(*KEY).distinct(), KEY, "left_anti")), "canonical")


def _bottom_up(own: DataFrame, done: DataFrame) -> DataFrame:
    while True:
        new = _ready(own, done)
        if new.isEmpty():
            return done
        done = done.union(new)


def _hashed_cycles(own: DataFrame, done: DataFrame, comps: DataFrame) -> DataFrame:
    """(…, canonical) of the cycles (comp) that name no unhashed node outside.

    Colours: each node's statements, with the colours that its neighbours in the cycle had a round before, until a cycle's number of colours no
    longer grows. Nodes that are still alike are told apart by where they are seen from: a node's hash is its colour, then, with the node marked, the
    colours that the cycle refines to. Rounds are a matter of each cycle alone, so equal cycles have equal hashes anywhere.
    """
    rows = _named(own.join(done, KEY, "left_anti"), done).join(comps, KEY)
    other = comps.select("ontology_id", F.col("id").alias("value"), F.col("comp").alias("to"))
    rows = rows.join(other, ["ontology_id", "value"], "left").withColumn("inner", (F.col("kind") == "bnode") & F.col("canonical").isNull() & F.col("to").eqNullSafe(F.col("comp")))
    blocked = rows.where("kind = 'bnode' and canonical is null and not inner").select("comp").distinct()
    rows = staged(rows.join(blocked, "comp", "left_anti"), "cycle-rows")
    if rows.isEmpty():
        return done.where("false")
    plain = _refined(rows.withColumn("root", F.lit("")), None)
    nodes = rows.select(*KEY, "comp").distinct()
    # every node of a cycle as root: a cycle of n nodes is looked at n times, n being what one expression holds
    roots = nodes.select("comp", F.col("id").alias("root"))
    seen = _refined(rows.join(roots, "comp"), plain)
    shown = F.sha2(F.to_json(F.sort_array(F.collect_list("colour"))), 256)
    views = seen.groupBy("ontology_id", F.col("root").alias("id")).agg(shown.alias("view"))
    return staged(plain.join(views, KEY).select(*KEY, F.sha2(F.concat_ws(" ", F.lit("cycle"), "colour", "view"), 256).alias("canonical")), "canonical")


def _refined(rows: DataFrame, start: DataFrame | None) -> DataFrame:
    """(…, root, comp, colour) of the nodes of cycles, a colouring for each (comp, root), refined until it has no more colours than the round before."""
    key = [*KEY, "comp", "root"]
    first = rows.select(*key).distinct()
    if start is not None:
        first = first.join(start.select(*KEY, "colour"), KEY)
    base = F.col("colour") if start is not None else F.lit("")
    now = staged(first.select(*key, F.when(F.col("id") == F.col("root"), F.concat(F.lit("root "), base)).otherwise(base).alias("colour")), "colours")
    counts = now.groupBy("comp", "root").agg(F.count_distinct("colour").alias("n"))
    open_, out = now, None
    while True:
        told = open_.select("ontology_id", F.col("id").alias("value"), "comp", "root", F.col("colour").alias("far"))
        own = rows.join(open_.select("comp", "root").distinct(), ["comp", "root"], "left_semi").join(told, ["ontology_id", "value", "comp", "root"], "left")
        line = F.struct("predicate", "pos", "kind", F.when(F.col("inner"), F.col("far")).otherwise(F.col("canonical")).alias("c"), "datatype", "lang")
        lines = own.groupBy(*key).agg(F.to_json(F.sort_array(F.collect_list(line))).alias("lines"))
        new = staged(lines.join(open_, key).select(*key, F.sha2(F.concat_ws(" ", "colour", "lines"), 256).alias("colour")), "colours")
        after = staged(new.groupBy("comp", "root").agg(F.count_distinct("colour").alias("n")), "colour-counts")
        grown = after.join(counts.withColumnRenamed("n", "was"), ["comp", "root"]).where("n > was").select("comp", "root")
        ended = new.join(grown, ["comp", "root"], "left_anti")
        out = ended if out is None else out.union(ended)
        open_ = staged(new.join(grown, ["comp", "root"], "left_semi"), "colours")
        if open_.isEmpty():
            return staged(out, "coloured")
        counts = after


def ontology_nodes(nodes: DataFrame, props: DataFrame, config: DataFrame) -> DataFrame:
    """(ontology_id, iri, stated): the node that stands for each ontology of the config (ontology_id, base_uris, path).

    The first typed as an ontology in the ontology's own file; else the only named node of no known type; else the first base URI; else the path.
    """
    named = nodes.where(~F.col("bnode"))
    own = named.where(_is("ontology")).groupBy("ontology_id").agg(F.min_by("id", F.struct("imported", "id")).alias("own"))
    untyped = named.where(F.size("types") == 0).join(props.where(F.col("predicate") == V.TYPE).select(*KEY), KEY, "left_anti")
    lone = untyped.groupBy("ontology_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lone")).where("n = 1").drop("n")
    out = config.select("ontology_id", "base_uris", "path").join(own, "ontology_id", "left").join(lone, "ontology_id", "left")
    return out.select("ontology_id", F.coalesce("own", "lone", F.try_element_at("base_uris", F.lit(1)), "path").alias("iri"), F.col("own").isNotNull().alias("stated"))
