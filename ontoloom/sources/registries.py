"""Reference tables that links are resolved with: a prefix registry in JSON, database cross-reference patterns in YAML, and person records in XML."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import text

_RECORD = "struct<preferred_prefix:string,synonyms:array<string>,pattern:string,uri_format:string>"
_MEMBER = pa.schema([("name", pa.string()), ("content", pa.string())])


def prefix_registry(spark: SparkSession, path: str) -> DataFrame:
    """(database, prefix, pattern, uri_format, uri_prefix): a row for each spelling of a database's prefix, in its normal form.

    The file is one JSON object of databases. ``prefix`` is the key, the preferred prefix or a synonym; where databases share
    a spelling, the last in key order has it. ``uri_prefix`` is the format up to a closing ``$1``, null for other formats. Absent fields are null.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{_RECORD}>")).alias("database", "r"))
    names = F.array_compact(F.concat(F.array("database", "r.preferred_prefix"), F.coalesce("r.synonyms", F.array().cast("array<string>"))))
    each = rows.select("database", F.explode(F.array_distinct(F.transform(names, text.normal_prefix))).alias("prefix"), "r.pattern", "r.uri_format")
    own = each.groupBy("prefix").agg(F.max_by(F.struct("database", "pattern", "uri_format"), "database").alias("b"))
    stem = F.when(F.col("b.uri_format").endswith("$1"), F.regexp_replace("b.uri_format", r"\$1$", ""))
    return own.select("b.database", "prefix", "b.pattern", "b.uri_format", stem.alias("uri_prefix"))


def uri_prefixes(registry: DataFrame) -> DataFrame:
    """(prefix, uri_prefix) for ``link.url_to_curie``: each URI prefix once, with the canonical name of its database."""
    return registry.where("uri_prefix <> ''").groupBy("uri_prefix").agg(F.max("database").alias("prefix")).select("prefix", "uri_prefix")


def database_urls(spark: SparkSession, path: str) -> DataFrame:
    """(database, url_syntax) of a YAML list of databases: ``- database:`` items in the first column, ``url_syntax:`` below them.

    Names are in lower case. Of several patterns of a name the last in the file stands; a database without one is left out.
    """
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.split("value", r"(?m)^- ")).alias("at", "item"))
    plain = lambda c: F.regexp_replace(F.trim(c), "^[\"'](.*)[\"']$", "$1")
    name = plain(F.regexp_extract("item", r"(?m)^(?:  )?database:[ \t]*([^\n\r]*)", 1))
    patterns = F.regexp_extract_all("item", F.lit(r"(?m)^[ \t]+(?:- )?url_syntax:[ \t]*([^\n\r]+)"), F.lit(1))
    rows = items.select("at", F.lower(name).alias("database"), F.try_element_at(patterns, F.lit(-1)).alias("u")).where("database <> '' and u is not null")
    return rows.groupBy("database").agg(plain(F.max_by("u", "at")).alias("url_syntax"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record files within archives: zip files of packed tar files, packed tar files, or bare XML; one record is held at a time."""

    def records(path: str, data: bytes) -> Iterator[tuple[str, str]]:
        if path.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as outer:
                for name in outer.namelist():
                    if name.endswith(".tar.gz"):
                        with outer.open(name) as inner:
                            yield from untarred(inner)
        elif path.endswith((".tar.gz", ".tgz")):
            yield from untarred(io.BytesIO(data))
        elif path.endswith(".xml"):
            yield path, data.decode("utf-8", "replace")

    def untarred(stream) -> Iterator[tuple[str, str]]:
        with tarfile.open(fileobj=stream, mode="r|gz") as tar:
            for member in tar:
                if member.isfile() and member.name.endswith(".xml"):
                    yield member.name, tar.extractfile(member).read().decode("utf-8", "replace")

    def packed(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_MEMBER)

    for batch in batches:
        for row in batch.to_pylist():
            rows: list[tuple[str, str]] = []
            for record in records(row["path"].lower(), row["content"]):
                rows.append(record)
                if len(rows) == 1000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)


def people(spark: SparkSession, path: str) -> DataFrame:
    """(key, source, url, label) of person records: label is ``family, given``, or the one of them there is.

    ``path`` may be a glob. Archives are opened a task each, so many small ones spread better than one; the fields are XPath
    expressions that Spark evaluates. Records without an identifier are left out; of repeated ones the least label stays.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(_members, "name string, content string")
    # prefixes of namespaces differ from file to file, so paths go by local names
    step = lambda *names: "/" + "/".join(f"*[local-name()='{n}']" for n in names) + "/text()"
    field = lambda *names: F.nullif(F.trim(F.xpath_string("content", F.lit(step("record", *names)))), F.lit(""))
    rows = found.select(field("orcid-identifier", "uri").alias("key"), F.concat_ws(", ", field("person", "name", "family-name"), field("person", "name", "given-names")).alias("label"))
    once = rows.where("key is not null").groupBy("key").agg(F.min("label").alias("label"))
    return once.select("key", F.lit("ORCID").alias("source"), F.col("key").alias("url"), "label")
