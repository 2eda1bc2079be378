"""Scalar expressions of ontology records: short forms, CURIEs, cross references, languages, trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(iri: Column) -> Column:
    """What follows the last slash or hash; of a urn, what follows ``urn:``."""
    return F.when(iri.startswith("urn:"), F.substr(iri, F.lit(5))).otherwise(F.regexp_extract(iri, r"([^/#]*)$", 1))


def short_form(iri: Column, base_uris: Column | None = None, prefix: Column | None = None) -> Column:
    """``PREFIX_rest`` under one of the ontology's base URIs (an array), else the local name."""
    if base_uris is None or prefix is None:
        return local_name(iri)
    base = F.try_element_at(F.filter(base_uris, lambda b: iri.startswith(b)), F.lit(1))
    return F.when(base.isNotNull(), F.concat(prefix, F.lit("_"), F.substr(iri, F.length(base) + 1))).otherwise(local_name(iri))


def curie(short: Column) -> Column:
    """A last underscore before digits becomes a colon."""
    return F.regexp_replace(short, r"_(\d+)$", ":$1")


def normal_prefix(prefix: Column) -> Column:
    """Registry key: lower case without dots, hyphens, underscores and slashes."""
    return F.translate(F.lower(prefix), ".-_/", "")


def looks_like_curie(s: Column) -> Column:
    return s.rlike(r"^[A-z0-9]+:[A-z0-9]+$")


def xref(s: Column) -> Column:
    """struct<database, id, url> of a cross reference: a web address is its own id; ``DB:ID`` is split, only its second part kept."""
    parts = F.split(s, ":")
    none = F.lit(None).cast("string")
    web = F.struct(none.alias("database"), s.alias("id"), s.alias("url"))
    bare = F.struct(none.alias("database"), s.alias("id"), none.alias("url"))
    pair = F.struct(parts[0].alias("database"), parts[1].alias("id"), none.alias("url"))
    return F.when(s.rlike("^https?:"), web).when(s.rlike("^[A-Z]+:.+://") | (F.size(parts) < 2), bare).otherwise(pair)


def path_id(path: Column) -> Column:
    """Tree identity of a path: base64 of its ids joined by semicolons."""
    return F.regexp_replace(F.base64(F.encode(F.array_join(path, ";"), "utf-8")), "[\r\n]", "")


def localised(values: Column, lang: str, default: str = "en") -> Column:
    """Of an array of struct<value, lang>: values in ``lang``, else the untagged, else the default language's, else null."""
    def of(test):
        kept = F.transform(F.filter(values, test), lambda v: v["value"])
        return F.when(F.size(kept) > 0, kept)

    plain = lambda v: v["lang"].isNull() | (v["lang"] == "")
    return F.coalesce(of(lambda v: F.lower(v["lang"]) == lang.lower()), of(plain), of(lambda v: v["lang"] == default))


def first_text(values: Column) -> Column:
    """The alphabetically first of an array."""
    return F.array_min(values)


def highlighted(text: Column, tokens: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Each token, in any case, between marks."""
    if not tokens:
        return text
    import re

    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(t) for t in tokens) + ")", f"{before}$1{after}")


def marked_tokens(text: Column, tokens: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Each white-space token that is one of ``tokens`` as written, between marks."""
    if not tokens:
        return text
    import re

    return F.regexp_replace(text, r"(?<!\S)(" + "|".join(re.escape(t) for t in tokens) + r")(?!\S)", f"{before}$1{after}")


def version_of(iri: Column) -> Column:
    """The date in a version IRI, else its ``/v…/`` part."""
    date, tag = F.regexp_extract(iri, r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(iri, r"/(v[^/]+)/", 1)
    return F.when(date != "", date).when(tag != "", tag)


def cache_name(url: Column) -> Column:
    return F.regexp_replace(url, "[^a-zA-Z0-9.-]", "_")


def rendered_number(lexical: Column) -> Column:
    """An integer where the text is one that fits, else a double, as text."""
    whole = lexical.try_cast("int")
    return F.coalesce(whole.cast("string"), lexical.try_cast("double").cast("string"))
