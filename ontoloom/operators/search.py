"""Search over flat entity documents: weighted match, boosts, conjunctive filters, facets, groups and pages.

A document frame has one row for each entity; fields are strings or arrays of strings. A score is what the fields that match
give (see ``SearchSpec.combine``) plus the boosts that hold; ties fall back to the id, so pages never overlap. The functions here look
at every row; ``operators.textindex`` answers the same specifications from an index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Rows of a page at most.
PAGE_LIMIT = 1000
#: How a field is matched.
WHOLE, TOKENS, LOWER_TOKENS, EDGES, SPACE_TOKENS, SPACE_EDGES = "whole", "tokens", "lower", "edge", "whitespace", "whitespace_edge"
#: All tokens in a row, in lower case.
PHRASE = "phrase"
#: What matching fields give: the greatest weight; for each word of the text, which must match somewhere, the greatest weight, summed;
#: as before, but one point in all; or the sum of weights.
BEST, EVERY, HELD, SUM = "best", "every", "held", "sum"
# Fields and boosts of the default entity search.
DEFAULT_FIELDS = ("iri", "ontologyId", "curie", "shortForm", "label", "id", "oboId", "synonym", "searchableAnnotationValues")
DEFAULT_BOOSTS = (("type", "ontology", 10, WHOLE), ("isDefiningOntology", "true", 1000, WHOLE), ("label", None, 1000, WHOLE), ("label", None, 500, EDGES), ("curie", None, 500, EDGES), ("shortForm", None, 500, EDGES), ("synonym", None, 500, WHOLE))
V1_FIELDS = {"short_form": "shortForm", "obo_id": "curie", "ontology_name": "ontologyId", "description": "definition", "annotations_trimmed": "searchableAnnotationValues"}
V1_SAME = ("label", "synonym", "definition", "iri", "type")
RESERVED = ("search", "searchFields", "boostFields", "facetFields", "exactMatch", "lang", "page", "size", "sort", "includeObsoleteEntities")


@dataclass(frozen=True)
class SearchSpec:
    text: str | None = None
    exact: bool = False
    fields: tuple[tuple[str, float, str], ...] = ()  # name, weight, match
    boosts: tuple[tuple[str, str | None, float, str], ...] = ()  # name, value (None: the text), weight, match
    filters: dict[str, list[str]] = field(default_factory=dict)
    facets: tuple[str, ...] = ()
    start: int = 0
    rows: int = 20
    combine: str = BEST


def checked_lang(lang: str) -> str:
    if not re.fullmatch("[-A-Za-z]+", lang):
        raise ValueError(f"not a language: {lang!r}")
    return lang


def checked_ontology(name: str) -> str:
    if not re.fullmatch("[-A-Za-z0-9_]+", name):
        raise ValueError(f"not an ontology id: {name!r}")
    return name.lower()


def field_specs(text: str, honor_weights: bool = True) -> list[tuple[str, str | None, float]]:
    """(name, value, weight) of ``name[:value][^weight]`` items that white space parts."""
    out = []
    for item in text.split():
        body, *weight = item.split("^")
        if len(weight) > 1:
            raise ValueError(f"more than one weight: {item!r}")
        name, _, value = body.partition(":")
        out.append((name, value.strip('"') or None, float(weight[0]) if weight and honor_weights else 1.0))
    return out


def v1_field(spec: str) -> tuple[str, float, str] | None:
    """A legacy field name with suffix and weight as (field, weight, match); None for unknown names."""
    name, _, weight = spec.partition("^")
    match = SPACE_EDGES
    for suffix, kind in (("_s", LOWER_TOKENS), ("_e", EDGES)):
        if name.endswith(suffix) and name not in V1_FIELDS:
            name, match = name[: -len(suffix)], kind
    mapped = V1_FIELDS.get(name, name if name in V1_SAME else None)
    return mapped and (mapped, float(weight or 1), match)


def dynamic_filters(params: dict[str, list[str]], include_obsolete: bool = False) -> dict[str, list[list[str]]]:
    """Query parameters that are no reserved words: each repeat is a filter (AND) over its comma-parted values (OR)."""
    out = {} if include_obsolete or "isObsolete" in params else {"isObsolete": [["false"]]}
    for name, values in params.items():
        if name not in RESERVED:
            out[name] = [v.split(",") for v in values]
    return out


def values_of(df: DataFrame, name: str) -> Column:
    """A field as an array of strings."""
    kind = dict(df.dtypes)[name]
    return F.col(name).cast("array<string>") if kind.startswith("array") else F.array(F.col(name).cast("string"))


def words(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def wanted_tokens(text: str, how: str) -> list[str]:
    """Tokens of a searched text under a match mode."""
    if how == WHOLE:
        return [text]
    lowered = text if how == TOKENS else text.lower()
    spaced = how in (TOKENS, SPACE_TOKENS, SPACE_EDGES)
    return lowered.split() if spaced else [w for w in re.split(r"[^\w]+|_", lowered) if w]


def matches(df: DataFrame, name: str, text: str, how: str) -> Column:
    """Whether any value of a field matches. Tokens: every token of the text is one of the value's (or begins one), of a phrase in a row.

    A token is looked for between its separators, which stops at the first hit and never builds the value's tokens.
    """
    values = values_of(df, name)
    if how == WHOLE:
        return F.coalesce(F.array_contains(values, text), F.lit(False))
    wanted = wanted_tokens(text, how)
    if not wanted:
        return F.lit(False)
    spaced = how in (TOKENS, SPACE_TOKENS, SPACE_EDGES)
    before, after = (r"(?<!\S)", r"(?!\S)") if spaced else (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])")
    if how == PHRASE:
        patterns = [before + r"[^\p{L}\p{N}]+".join(map(re.escape, wanted)) + after]
    else:
        patterns = [before + re.escape(w) + ("" if how in (EDGES, SPACE_EDGES) else after) for w in wanted]
    folded = values if how == TOKENS else F.transform(values, F.lower)
    return F.coalesce(F.exists(folded, lambda v: reduce(Column.__and__, [v.rlike(p) for p in patterns])), F.lit(False))


def filtered(df: DataFrame, filters: dict[str, list[str]], fold: bool = False) -> DataFrame:
    """AND over fields of OR over values; no row has a field that the table lacks.

    Whole values, so plain fields stay plain predicates that reach the scan; ``fold``: a value's tokens stand in a row in the field, in any case.
    """
    for name, wanted in filters.items():
        if name not in df.columns:
            return df.where("false")
        if fold:
            df = df.where(reduce(Column.__or__, [matches(df, name, w, PHRASE) for w in wanted], F.lit(False)))
        elif dict(df.dtypes)[name].startswith("array"):
            df = df.where(F.arrays_overlap(values_of(df, name), F.array(*[F.lit(w) for w in wanted])))
        else:
            column = F.col(name)
            df = df.where(column.isin(wanted) if dict(df.dtypes)[name] == "string" else column.cast("string").isin(wanted))
    return df


def clauses(spec: SearchSpec) -> list[list[tuple[str, str, float, str]]]:
    """Groups of (field, text, weight, match): of a group the greatest weight that matches counts."""
    text = spec.text or ""
    how_of = lambda how: WHOLE if spec.exact else how
    if spec.combine in (EVERY, HELD):
        # a word that is nothing but separators to every field asks for nothing
        groups = [[(n, word, w, how_of(how)) for n, w, how in spec.fields if wanted_tokens(word, how_of(how))] for word in text.split()]
        return [g for g in groups if g]
    each = [(n, text, w, how_of(how)) for n, w, how in spec.fields]
    return [[c] for c in each] if spec.combine == SUM else [each] if each else []


def combined(spec: SearchSpec, best: list[Column], boost: Column) -> Column:
    """The score from the best weight of each group of ``clauses`` (0.0 where none matches); 0.0 is no hit."""
    if not best:
        return F.lit(0.0) if spec.fields or spec.combine != BEST else F.lit(1.0) + boost
    if spec.combine in (EVERY, HELD):
        held = reduce(Column.__and__, [b > 0 for b in best])
    else:
        held = reduce(Column.__or__, [b > 0 for b in best])
    points = F.lit(1.0) if spec.combine == HELD else sum(best[1:], best[0])
    return F.when(held, points + boost).otherwise(F.lit(0.0))


def score(df: DataFrame, spec: SearchSpec) -> Column:
    text, zero = spec.text or "", F.lit(0.0)
    points = lambda c: F.when(matches(df, c[0], c[1], c[3]), F.lit(float(c[2]))).otherwise(zero)
    best = [F.greatest(*map(points, g)) if len(g) > 1 else points(g[0]) for g in clauses(spec)]
    boost = sum((points((n, v or text, w, how)) for n, v, w, how in spec.boosts if v or text), zero)
    return combined(spec, best, boost)


def search(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """All matching rows with their score; without a text every filtered row scores 1."""
    kept = filtered(df, spec.filters)
    if not spec.text:
        return kept.withColumn("score", F.lit(1.0))
    # a generated column is computed once, where a plain one would be for the filter and again for the result
    return kept.select("*", F.explode(F.array(score(kept, spec))).alias("score")).where("score > 0")


def page(df: DataFrame, start: int, rows: int, order: list | None = None, key: str = "id") -> DataFrame:
    """A page in a total order: a bounded top-k, never a full sort of the result on one task."""
    return df.orderBy(*(order or [F.desc("score")]), key).limit(start + min(rows, PAGE_LIMIT)).offset(start)


def facets(df: DataFrame, spec: SearchSpec, find=search) -> DataFrame:
    """(field, value, n) of each facet field, over rows that all filters but those on facet fields hold for. ``find`` searches (see ``search``)."""
    free = find(df, replace(spec, filters={k: v for k, v in spec.filters.items() if k not in spec.facets}))
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), values_of(df, n).alias("values")) for n in spec.facets]))
    return free.select(stacked.alias("f")).select("f.field", F.explode("f.values").alias("value")).where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def collapsed(df: DataFrame, by: str, key: str = "id") -> DataFrame:
    """The best row of each group: highest score, then least key. Combines before the shuffle, so one common value is no burden."""
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(-F.col("score"), F.col(key)))
    return df.groupBy(F.col(by).alias("__by")).agg(best.alias("r")).select("r.*")


def expanded(df: DataFrame, by: str, rows: int = 100, key: str = "id") -> DataFrame:
    """Each group's best row (place 0) and up to ``rows`` more, by score, then key; column ``place`` counts them.

    A task keeps only a group's first rows before they meet, so a common value costs its tasks times ``rows`` and no more.
    """
    own = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(key))
    return df.withColumn("place", F.row_number().over(own)).where(F.col("place") <= rows + 1).withColumn("place", F.col("place") - 1)


def suggest(df: DataFrame, text: str, label: str = "label") -> DataFrame:
    """(label, score) by label that begins with the text or holds a word that does, highest score first."""
    low, begin = F.lower(label), text.lower()
    points = F.when(low == begin, 10.0).when(low.startswith(begin), 2.0).when(F.exists(words(F.col(label)), lambda w: w.startswith(begin)), 1.0)
    return df.select(F.col(label).alias("label"), points.alias("score")).where("score is not null").groupBy("label").agg(F.max("score").alias("score"))


def subtree(df: DataFrame, pairs: DataFrame, top: list[str], inclusive: bool = False) -> DataFrame:
    """Rows below any of ``top`` by a closure (src, dst), with ``top`` themselves where inclusive."""
    below = pairs.where(F.col("dst").isin(top)).select(F.col("src").alias("id"))
    if inclusive:
        below = below.union(df.where(F.col("id").isin(top)).select("id"))
    return df.join(below.distinct(), "id", "left_semi")


def answered(hits: DataFrame, start: int, rows: int, order: list | None = None, key: str = "id") -> dict:
    """A page in its wrapper: rows and their total from one job, as the rows that the page is cut from are counted on their way."""
    seen = Observation()
    elements = page(hits.observe(seen, F.count(F.lit(1)).alias("total")), start, rows, order, key).collect()
    return envelope(seen.get["total"], start, rows, [r.asDict(recursive=True) for r in elements])


def envelope(total: int, start: int, rows: int, elements: list) -> dict:
    """The page wrapper of API answers."""
    rows = max(1, min(rows, PAGE_LIMIT))
    return {"page": start // rows, "numElements": len(elements), "totalPages": -(-total // rows), "totalElements": total, "elements": elements}
