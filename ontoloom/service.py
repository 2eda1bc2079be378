"""The query API as Python functions over the tables of a load: each endpoint's answer is a DataFrame.

``documents`` has a row for each entity: id, iri, ontologyId, type (array), label (array), and whichever of synonym, definition, shortForm, curie,
isObsolete, isDefiningOntology, imported, isPreferredRoot, hasDirectParents, hasDirectChildren, hasHierarchicalParents, hasHierarchicalChildren,
subset and annotations (map of name to values) a load has; flags are booleans. ``edges`` has src, edge_type, dst (document ids) and props.
"""

from __future__ import annotations

from base64 import b64decode
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import highlighted, marked_tokens, path_id
from ontoloom.functions.vocabulary import SUBCLASS, TYPE
from ontoloom.operators import graph, search, textindex, treepage
from ontoloom.operators.search import BEST, EDGES, EVERY, HELD, LOWER_TOKENS, PHRASE, SPACE_EDGES, SUM, WHOLE, SearchSpec
from ontoloom.plans.staging import staged

DIRECT, HIERARCHICAL = ("directParent",), ("hierarchicalParent",)
#: Relation of an entity -> (edge types, against the edges, any number of steps).
RELATIONS = {
    "parents": (DIRECT, False, False),
    "hierarchicalParents": (HIERARCHICAL, False, False),
    "ancestors": (DIRECT, False, True),
    "hierarchicalAncestors": (HIERARCHICAL, False, True),
    "children": (DIRECT, True, False),
    "hierarchicalChildren": (HIERARCHICAL, True, False),
    "descendants": (DIRECT, True, True),
    "hierarchicalDescendants": (HIERARCHICAL, True, True),
    "types": ((TYPE,), False, False),
    "alltypes": ((TYPE, SUBCLASS), False, True),
    "individuals": ((TYPE,), True, False),
}
# Fields and boosts of the endpoints' default searches, and the facets of the legacy search.
KIND_FIELDS = "label^100 definition"
ONTOLOGY_FIELDS = "label^100 ontologyId^100 definition"
SEARCH_FIELDS = (("label", 5.0), ("synonym", 3.0), ("definition", 1.0), ("shortForm", 2.0), ("curie", 2.0), ("iri", 1.0), ("searchableAnnotationValues", 1.0))
SEARCH_BOOSTS = (("isDefiningOntology", "true", 100.0, WHOLE), ("label", None, 5.0, LOWER_TOKENS), ("synonym", None, 3.0, LOWER_TOKENS))
EXACT_FIELDS = (("label", 5.0, LOWER_TOKENS), ("synonym", 3.0, LOWER_TOKENS), ("shortForm", 2.0, LOWER_TOKENS), ("curie", 2.0, LOWER_TOKENS), ("iri", 1.0, LOWER_TOKENS), ("searchableAnnotationValues", 1.0, SPACE_EDGES))
EXACT_BOOSTS = (("label", None, 10.0, PHRASE), ("synonym", None, 5.0, PHRASE), ("isDefiningOntology", "true", 100.0, WHOLE))
SELECT_FIELDS = ("label", "synonym", "shortForm", "curie", "iri")
SELECT_BOOSTS = (("type", "ontology", 10.0, WHOLE), ("isDefiningOntology", "true", 100.0, WHOLE), ("label", None, 1000.0, WHOLE), ("label", None, 500.0, EDGES), ("synonym", None, 1.0, WHOLE), ("synonym", None, 100.0, EDGES))
# Fields of the legacy answers as (field of a document, one text of it or all), and those given where none is asked for.
LISTED = {
    "id": ("id", "one"), "iri": ("iri", "one"), "ontology_name": ("ontologyId", "one"), "label": ("label", "one"), "description": ("definition", "all"), "short_form": ("shortForm", "one"),
    "obo_id": ("curie", "one"), "is_defining_ontology": ("isDefiningOntology", "flag"), "type": ("type", "first"), "synonym": ("synonym", "all"), "ontology_prefix": ("ontologyPreferredPrefix", "one"),
    "subset": ("subset", "all"), "ontology_iri": ("ontologyIri", "one"), "score": ("score", "same"),
}
LISTED_DEFAULT = ("id", "iri", "ontology_name", "label", "description", "short_form", "obo_id", "type", "ontology_prefix")
SEARCH_FACETS = ("ontologyId", "ontologyIri", "ontologyPreferredPrefix", "type", "isDefiningOntology", "isObsolete")


@dataclass(frozen=True)
class Answer:
    """All hits with their score; ``page`` cuts one, ``total`` counts them, ``response`` does both in one job, ``facets`` counts values.

    Where hits were grouped, ``expanded`` has each group's first rows, the hit itself in place 0.
    """

    hits: DataFrame
    facets: DataFrame | None = None
    expanded: DataFrame | None = None

    def response(self, number: int = 0, size: int = 20) -> dict:
        """A page as API answers wrap it: page, numElements, totalPages, totalElements, elements."""
        size = max(1, min(size, search.PAGE_LIMIT))
        return search.answered(self.hits, number * size, size)

    def total(self) -> int:
        return self.hits.count()

    def page(self, number: int = 0, size: int = 20) -> DataFrame:
        return search.page(self.hits, number * min(size, search.PAGE_LIMIT), size)


def indexed_fields() -> dict[str, tuple[str, ...]]:
    """Fields and kinds of tokens that an index for all default searches holds."""
    spaced = lambda names: tuple((n, 1.0, SPACE_EDGES) for n in names)
    return textindex.kinds_for(
        SearchSpec(fields=spaced((*search.DEFAULT_FIELDS, *(n for n, _ in SEARCH_FIELDS), *SELECT_FIELDS)), boosts=(*search.DEFAULT_BOOSTS, *SEARCH_BOOSTS, *SELECT_BOOSTS)),
        SearchSpec(fields=EXACT_FIELDS, boosts=EXACT_BOOSTS), SearchSpec(exact=True, fields=spaced(search.DEFAULT_FIELDS)),
    )


class Service:
    """Answers over the tables of a load; with an ``index`` of its documents, searches by text read postings and no texts."""

    def __init__(self, documents: DataFrame, edges: DataFrame, index: textindex.TextIndex | None = None):
        self.documents, self.edges, self.index = documents, edges, index
        self._names = set(documents.columns)

    def _search(self, docs: DataFrame, spec: SearchSpec) -> DataFrame:
        return self.index.search(docs, spec) if self.index else search.search(docs, spec)

    # --- statistics ---------------------------------------------------------------------------------------------------

    def stats(self) -> DataFrame:
        """(type, n): how many documents are of each type."""
        return self.documents.select(F.explode("type").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def healthy(self) -> bool:
        """Whether the load has an ontology and any edge."""
        return not self._of("ontology").isEmpty() and not self.edges.isEmpty()

    # --- entities -----------------------------------------------------------------------------------------------------

    def _of(self, kind: str, ontology: str | None = None) -> DataFrame:
        """Documents of a kind (class, property, individual, ontology, or entity for all but ontologies)."""
        docs = self.documents
        docs = docs.where(~F.array_contains("type", "ontology")) if kind == "entity" else docs.where(F.array_contains("type", kind))
        return docs if ontology is None else docs.where(F.col("ontologyId") == search.checked_ontology(ontology))

    def _flag(self, name: str):
        """A flag that a load may lack; then no document has it."""
        return F.coalesce(F.col(name), F.lit(False)) if name in self._names else F.lit(False)

    def _have(self, fields) -> tuple:
        return tuple(f for f in fields if f[0] in self._names)

    def entities(self, kind: str = "entity", ontology: str | None = None, text: str | None = None, fields: str | None = None, boosts: str | None = None, facets: tuple[str, ...] = (), exact: bool = False, obsolete: bool = False, **params: list[str]) -> Answer:
        """Documents of a kind by text and properties: a parameter's values are alternatives where commas part them, and repeats all hold.

        Filters on facet fields do not bear on the facets' counts. Obsolete ones are left out unless asked for or filtered for.
        """
        docs = self._of(kind, ontology)
        wanted = search.dynamic_filters(params, obsolete)
        plain = docs
        for name, repeats in wanted.items():
            if name == "isObsolete" and name not in self._names:
                continue
            for values in repeats:
                docs = search.filtered(docs, {name: values}, fold=True)
                plain = plain if name in facets else search.filtered(plain, {name: values}, fold=True)
        if fields is not None or kind != "entity":
            named = tuple((n, w, SPACE_EDGES) for n, _, w in search.field_specs(fields or (ONTOLOGY_FIELDS if kind == "ontology" else KIND_FIELDS)))
        else:
            named = tuple((n, 1.0, SPACE_EDGES) for n in search.DEFAULT_FIELDS)
        raised = tuple((n, v, w, WHOLE) for n, v, w in search.field_specs(boosts)) if boosts else search.DEFAULT_BOOSTS
        spec = SearchSpec(text, exact, self._have(named), self._have(raised), {}, tuple(facets))
        return Answer(self._search(docs, spec), search.facets(plain, spec, self._search) if facets else None)

    def entity(self, kind: str, ontology: str, iri: str):
        """The one document; LookupError where there is none."""
        return graph.one(self._of(kind, ontology).where(F.col("iri") == iri))

    def find(self, kind: str, iri: str | None = None, short_form: str | None = None, obo_id: str | None = None, any_id: str | None = None, ontology: str | None = None, defining: bool = False) -> DataFrame:
        """Documents by the first kind of name given, or for ``any_id`` by the first of IRI, short form and OBO id that some document has."""
        docs = self._of(kind, ontology)
        if defining:
            docs = docs.where(self._flag("isDefiningOntology"))
        columns = [c for c in ("iri", "shortForm", "curie") if c in self._names]
        if any_id is not None:
            rank = F.coalesce(*[F.when(F.col(c) == any_id, i) for i, c in enumerate(columns)])
            hits = docs.withColumn("__rank", rank).where("__rank is not null")
            best = hits.agg(F.min("__rank").alias("__rank"))
            return hits.join(F.broadcast(best), "__rank", "left_semi").drop("__rank")
        for column, value in (("iri", iri), ("shortForm", short_form), ("curie", obo_id)):
            if value is not None:
                return docs.where(F.col(column) == value)
        return docs.where("false")

    def roots(self, kind: str, ontology: str, preferred: bool = False, obsolete: bool = False) -> DataFrame:
        """Entities without direct and hierarchical parents, or those flagged as preferred roots."""
        docs = self._of(kind, ontology)
        docs = docs.where("isPreferredRoot") if preferred else docs.where("not hasDirectParents and not hasHierarchicalParents")
        return docs if obsolete else docs.where(~self._flag("isObsolete"))

    def individual_roots(self, ontology: str, obsolete: bool = False) -> DataFrame:
        """Where a tree of individuals begins: classes that some individual has as its type, and individuals without parents."""
        typed = self.edges.where(F.col("edge_type") == TYPE).join(self._of("individual", ontology).select(F.col("id").alias("src")), "src", "left_semi")
        classes = self._of("class", ontology).join(typed.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        classes = classes if obsolete else classes.where(~self._flag("isObsolete"))
        return classes.unionByName(self.roots("individual", ontology, obsolete=obsolete))

    # --- graph --------------------------------------------------------------------------------------------------------

    def related(self, kind: str, ontology: str, iri: str, relation: str) -> DataFrame:
        """Documents that stand in a relation of ``RELATIONS`` to an entity; only what it reaches is walked."""
        types, incoming, all_steps = RELATIONS[relation]
        focus = self._of(kind, ontology).where(F.col("iri") == iri).select("id")
        if all_steps:
            ids = graph.reach_from(self.edges, focus, list(types), incoming).select("id")
        else:
            a, b = ("dst", "src") if incoming else ("src", "dst")
            own = self.edges.where(F.col("edge_type").isin(*types)).join(focus.withColumnRenamed("id", a), a, "left_semi")
            ids = own.select(F.col(b).alias("id"))
        return self.documents.join(ids.distinct(), "id", "left_semi")

    def by_property(self, ontology: str, iri: str, relation: str) -> DataFrame:
        """Classes that a class is related to by a property's IRI."""
        focus = self._of("class", ontology).where(F.col("iri") == iri).select(F.col("id").alias("src"))
        own = self.edges.where((F.col("edge_type") == "relatedTo") & F.array_contains(F.col("props")["property"], relation)).join(focus, "src", "left_semi")
        return self.documents.join(own.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")

    def neighbours(self, ontology: str, iri: str) -> DataFrame:
        """(focus, src, dst, edge_type): parents, children and related classes around a class, each edge once."""
        focus = self._of("class", ontology).where(F.col("iri") == iri).select("id")
        return graph.neighbourhood(self.edges, focus, ["directParent", "relatedTo"], ["directParent", "relatedTo"])

    def term_graph(self, ontology: str, iri: str) -> tuple[DataFrame, DataFrame]:
        """Nodes (iri, label) and edges (source, target, uri, label) around a class: its direct parents and children, and what is related either way.

        An edge's uri is its property, else subClassOf; its label is the property's, in the same ontology if that has one, else "is a". Labels of several
        texts show the alphabetically first. Ends that are no documents have no node.
        """
        focus = self._of("class", ontology).where(F.col("iri") == iri).select("id")
        kept = self.edges.where(F.col("edge_type").isin("directParent", "relatedTo"))
        out, into = kept.join(focus.withColumnRenamed("id", "src"), "src", "left_semi"), kept.join(focus.withColumnRenamed("id", "dst"), "dst", "left_semi")
        uri = F.coalesce(F.try_element_at(F.try_element_at("props", F.lit("property")), F.lit(1)), F.lit(SUBCLASS)) if "props" in kept.columns else F.lit(SUBCLASS)
        around = staged(out.unionByName(into).select("src", "dst", uri.alias("uri")).distinct(), "around")
        shown = self.documents.select("id", "iri", F.array_min(search.values_of(self.documents, "label")).alias("label"), "ontologyId")
        ends = around.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        nodes = staged(shown.join(ends, "id", "left_semi").select("id", "iri", "label"), "nodes")
        own = F.struct((F.col("ontologyId") != ontology.lower()).alias("other"), "ontologyId", "label")
        named = shown.where("label is not null").join(around.select(F.col("uri").alias("iri")).distinct(), "iri", "left_semi").groupBy(F.col("iri").alias("uri")).agg(F.min(own)["label"].alias("label"))
        a, b = (nodes.select(F.col("id").alias(end), F.col("iri").alias(name)) for end, name in (("src", "source"), ("dst", "target")))
        edges = around.join(a, "src").join(b, "dst").join(named, "uri", "left").select("source", "target", "uri", F.coalesce("label", F.lit("is a")).alias("label"))
        return nodes.select("iri", "label"), edges.distinct()

    def js_tree(self, kind: str, ontology: str, iri: str) -> DataFrame:
        """(id, node_id, parent_id, depth): the paths from the roots down to an entity, over it and its hierarchical ancestors."""
        focus = self._of(kind, ontology).where(F.col("iri") == iri).select("id")
        types = list(HIERARCHICAL if kind == "class" else DIRECT)
        nodes = graph.reach_from(self.edges, focus, types).select("id").union(focus).distinct()
        up = self.edges.where(F.col("edge_type").isin(types)).join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return graph.js_tree(nodes, up.select("src", "dst").distinct())

    def js_tree_page(self, kind: str, ontology: str, iri: str, start: int = 0, size: int = 20) -> tuple[int, DataFrame]:
        """How many paths lead from the roots to an entity, and the rows of ``js_tree`` for a page of them; the other paths are never built."""
        focus = staged(self._of(kind, ontology).where(F.col("iri") == iri).select("id"), "focus")
        types = list(HIERARCHICAL if kind == "class" else DIRECT)
        nodes = staged(graph.reach_from(self.edges, focus, types).select("id").union(focus).distinct(), "above")
        up = self.edges.where(F.col("edge_type").isin(types)).join(nodes.withColumnRenamed("id", "src"), "src", "left_semi")
        dag = treepage.acyclic(up)
        counts = treepage.path_counts(nodes, dag)
        total = counts.join(focus, "id", "left_semi").first()
        return int(total["n"]) if total else 0, treepage.tree_rows(treepage.paths(focus, dag, counts, start, min(size, search.PAGE_LIMIT)))

    def js_tree_children(self, kind: str, ontology: str, iri: str, node_id: str) -> DataFrame:
        """(id, node_id, parent_id, has_children): the children of an entity at the place ``node_id`` of a tree that ``js_tree`` gave."""
        kids = self.related(kind, ontology, iri, "hierarchicalChildren" if kind == "class" else "children")
        path = [F.lit(x) for x in b64decode(node_id).decode().split(";")]
        flags = [F.coalesce(F.col(n), F.lit(False)) for n in ("hasDirectChildren", "hasHierarchicalChildren") if n in self._names]
        return kids.select("id", path_id(F.array(*path, F.col("id"))).alias("node_id"), F.lit(node_id).alias("parent_id"), _any(flags).alias("has_children"))

    # --- legacy searches ----------------------------------------------------------------------------------------------

    def _restricted(self, ontologies=None, types=None, slims=None, local=False, leaf=False, obsolete=False, below=(), inclusive=False, local_flag="imported", relation="hierarchicalParent") -> DataFrame:
        docs = search.filtered(self.documents, {n: list(v) for n, v in (("ontologyId", ontologies), ("type", types), ("subset", slims)) if v})
        if local:
            docs = docs.where(~self._flag("imported") if local_flag == "imported" else self._flag(local_flag))
        if leaf:
            docs = docs.where("not hasDirectChildren and not hasHierarchicalChildren")
        docs = docs.where(self._flag("isObsolete") == obsolete)
        if below:
            tops = self.documents.where(F.col("iri").isin(*below)).select("id")
            ids = graph.reach_from(self.edges, tops, [relation], incoming=True).select("id")
            docs = docs.join((ids.union(tops) if inclusive else ids).distinct(), "id", "left_semi")
        return docs

    def search(self, text: str, fields: str | None = None, exact: bool = False, group: bool = False, facets: bool = False, **limits) -> Answer:
        """The legacy search: weighted fields, boosts, restrictions (see ``_restricted``), one hit for each IRI if grouped, with up to 100 more beside it.

        ``exact``: every word is a whole token of some field, in any case, and the text as a phrase raises a hit; with ``fields``, the text is
        a phrase of one of them, each a point. ``obsolete=True`` gives obsolete ones only; facets are counted over the hits.
        """
        text = None if text == "*" else text
        if fields:
            named = tuple(f for f in map(search.v1_field, fields.split(",")) if f)
            named = tuple((n, 1.0, PHRASE) for n, _, _ in named) if exact else named
            spec = SearchSpec(text, False, self._have(named), combine=SUM if exact else BEST)
        elif exact:
            spec = SearchSpec(text, False, self._have(EXACT_FIELDS), self._have(EXACT_BOOSTS), combine=EVERY)
        else:
            spec = SearchSpec(text, False, self._have(tuple((n, w, SPACE_EDGES) for n, w in SEARCH_FIELDS)), self._have(SEARCH_BOOSTS))
        hits = self._search(self._restricted(**limits), spec)
        counts = search.facets(hits, SearchSpec(facets=tuple(f for f in SEARCH_FACETS if f in self._names))) if facets else None
        return Answer(search.collapsed(hits, "iri"), counts, search.expanded(hits, "iri")) if group else Answer(hits, counts)

    def select(self, text: str, **limits) -> Answer:
        """The legacy autocomplete over entities: every word of the text begins a word of some field.

        ``label_autosuggest`` and ``synonym_autosuggest`` mark the words wherever they stand, ``label_marked`` and ``synonym_marked`` tokens as written.
        """
        words = text.split()
        named = self._have(tuple((n, 1.0, SPACE_EDGES) for n in SELECT_FIELDS))
        docs = self._restricted(local_flag="isDefiningOntology", **limits)
        hits = self._search(docs, SearchSpec(text, False, named, self._have(SELECT_BOOSTS), combine=HELD)) if words else docs.withColumn("score", F.lit(1.0)).where("false")
        for name in ("label", "synonym"):
            if name in self._names:
                hits = hits.withColumn(f"{name}_autosuggest", F.transform(search.values_of(hits, name), lambda v: highlighted(v, words)))
                hits = hits.withColumn(f"{name}_marked", F.transform(search.values_of(hits, name), lambda v: marked_tokens(v, words)))
        return Answer(hits)

    def listed(self, hits: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
        """The fields of ``LISTED`` that a legacy search asks for, in that order; of several texts the alphabetically first where one is shown.

        ``<name>_annotation`` gives the values of the annotation so labelled (map column ``annotations``). Unknown names give no column; what a
        load or a document lacks is null.
        """
        out = []
        for name in dict.fromkeys(fields or LISTED_DEFAULT):
            if name.endswith("_annotation"):
                key = name.removesuffix("_annotation")
                value = F.try_element_at("annotations", F.lit(key)) if "annotations" in hits.columns else F.lit(None).cast("array<string>")
            elif name not in LISTED:
                continue
            else:
                field, how = LISTED[name]
                if how == "flag":
                    value = self._flag(field)
                elif field not in hits.columns:
                    value = F.lit(None).cast("array<string>" if how == "all" else "double" if how == "same" else "string")
                else:
                    texts = search.values_of(hits, field)
                    value = {"same": F.col(field), "all": texts, "one": F.array_min(texts), "first": F.try_element_at(texts, F.lit(1))}[how]
            out.append(value.alias(name))
        return hits.select(*out)

    def flat_facets(self, counts: DataFrame) -> DataFrame:
        """(field, counts) of ``Answer.facets``: values and their counts in turn, as texts, the most frequent first. Facet fields have few values."""
        each = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", F.col("n").cast("string").alias("n"))))
        return counts.groupBy("field").agg(F.flatten(F.transform(each, lambda x: F.array(x["value"], x["n"]))).alias("counts"))

    def suggest(self, text: str) -> DataFrame:
        """(label, score) of labels and synonyms that begin with the text or hold a word that does."""
        names = [search.values_of(self.documents, n) for n in ("label", "synonym") if n in self._names]
        each = self.documents.select(F.explode(F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names])).alias("label"))
        return search.suggest(each, text)


def _any(tests) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out
