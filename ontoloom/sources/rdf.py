"""RDF files (RDF/XML, N-Triples, and Turtle of the kind ontologies are written in) as a table of triples.

``triples(spark, files)`` reads (ontology_id, file_rank, path) rows by Spark's own readers, so any store that Spark reads will do, and gives
ontology_id, file_rank, seq, s, s_bnode, p, o_kind, o, datatype, lang. N-Triples (paths that end in .nt, or .nt with a compression Spark knows) are read by
line and split over tasks. Any other file of up to ``WHOLE_BYTES`` is parsed by one task, which holds its bytes and one top-level element or statement
at a time; such files are many, and parsed side by side. Larger ones are cut into ranges that are parsed side by side (``rdfranges``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from io import BytesIO
from itertools import islice
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.vocabulary import FIRST, NIL, RDF, REST, TYPE, XSD
from ontoloom.sources import rdfranges

XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"
Triple = tuple[str, str, str, str, str, str]  # s, p, kind, o, datatype, lang
SCHEMA = "ontology_id string, file_rank int, seq long, s string, s_bnode boolean, p string, o_kind string, o string, datatype string, lang string"


class _Names:
    """Blank node labels of one file: given ones and fresh ones never meet, nor do fresh ones of its parts."""

    def __init__(self, scope: str, part: int = 0):
        self.scope, self.fresh_scope, self.n = scope, f"{scope}-p{part}" if part else scope, 0

    def given(self, label: str) -> str:
        return f"_:{self.scope}-n-{label}"

    def fresh(self) -> str:
        self.n += 1
        return f"_:{self.fresh_scope}-{self.n}"


def _literal(value: str, datatype: str = "", lang: str = "") -> tuple[str, str, str, str]:
    return "literal", value, datatype or ("" if lang else XSD + "string"), lang


def _node(iri: str) -> tuple[str, str, str, str]:
    return ("bnode" if iri.startswith("_:") else "uri"), iri, "", ""


def resolved(base: str, iri: str) -> str:
    """An IRI against a base. One with a scheme stands as it is, and an empty fragment stays, as many namespaces end in one."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    return urljoin(base, iri) + ("#" if iri.endswith("#") else "")


def _elements(data: bytes, head: bytes) -> Iterator[tuple[str, ElementTree.Element]]:
    """Starts and ends of the elements of a document, or of a range of top-level elements behind the head that opens their root."""
    if not head:
        yield from ElementTree.iterparse(BytesIO(data), ("start", "end"))
        return
    parser = ElementTree.XMLPullParser(("start", "end"))
    parser.feed(head)
    for at in range(0, len(data), 1 << 16):
        parser.feed(data[at : at + (1 << 16)])
        yield from parser.read_events()
    parser.flush()
    yield from parser.read_events()


def rdf_xml(data: bytes, base: str, scope: str, head: bytes = b"", part: int = 0) -> Iterator[Triple]:
    """Triples of an RDF/XML document: typed nodes, nested nodes, collections, resource and literal parse types, xml:base and xml:lang.

    An element below rdf:RDF is dropped as soon as its triples are given, so memory grows with the largest of them, not with the document.
    ``head`` opens the root where ``data`` is a part of the document only (``rdfranges``).
    """
    names = _Names(scope, part)

    def iri(tag: str) -> str:
        return tag[1:].replace("}", "") if tag[0] == "{" else tag

    def node(e, at: str, lang: str) -> Iterator[Triple]:
        at, lang = e.get(XML + "base", at), e.get(XML + "lang", lang)
        if (about := e.get(_R + "about")) is not None:
            s = resolved(at, about) if about else at.split("#")[0]
        elif (given := e.get(_R + "ID")) is not None:
            s = at.split("#")[0] + "#" + given
        elif (given := e.get(_R + "nodeID")) is not None:
            s = names.given(given)
        else:
            s = names.fresh()
        e.set("subject", s)
        if e.tag != _R + "Description":
            yield (s, TYPE, *_node(iri(e.tag)))
        for k, v in e.attrib.items():
            if k == _R + "type":
                yield (s, TYPE, *_node(resolved(at, v)))
            elif k[0] == "{" and not k.startswith((_R, XML)):
                yield (s, iri(k), *_literal(v, lang=lang))
        yield from props(s, e, at, lang)

    def props(s: str, e, at: str, lang: str) -> Iterator[Triple]:
        members = 0
        for child in e:
            members += child.tag == _R + "li"
            yield from prop(s, child, at, lang, members)

    def prop(s: str, e, at: str, lang: str, n: int) -> Iterator[Triple]:
        at, lang = e.get(XML + "base", at), e.get(XML + "lang", lang)
        p = iri(e.tag) if e.tag != _R + "li" else f"{RDF}_{n}"
        kind = e.get(_R + "parseType")
        if (target := e.get(_R + "resource")) is not None:
            yield (s, p, *_node(resolved(at, target)))
        elif (given := e.get(_R + "nodeID")) is not None:
            yield (s, p, *_node(names.given(given)))
        elif kind == "Collection":
            cells = [names.fresh() for _ in e]
            yield (s, p, *_node(cells[0] if cells else NIL))
            for cell, rest, member in zip(cells, [*cells[1:], NIL][: len(cells)], e, strict=True):
                yield from node(member, at, lang)
                yield (cell, FIRST, *_node(member.get("subject")))
                yield (cell, REST, *_node(rest))
        elif kind == "Resource":
            inner = names.fresh()
            yield (s, p, *_node(inner))
            yield from props(inner, e, at, lang)
        elif kind == "Literal":
            text = (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e)
            yield (s, p, *_literal(text, RDF + "XMLLiteral"))
        elif len(e):
            for child in e:
                yield from node(child, at, lang)
                yield (s, p, *_node(child.get("subject")))
        else:
            own = {k: v for k, v in e.attrib.items() if k[0] == "{" and not k.startswith((_R, XML))}
            if own:
                inner = names.fresh()
                yield (s, p, *_node(inner))
                for k, v in own.items():
                    yield (inner, iri(k), *_literal(v, lang=lang))
            else:
                kind = e.get(_R + "datatype", "")
                yield (s, p, *_literal(e.text or "", kind, "" if kind else lang))

    root, depth = None, 0
    for event, e in _elements(data, head):
        root = e if root is None else root
        depth += 1 if event == "start" else -1
        if event == "end" and depth == (1 if root.tag == _R + "RDF" else 0):
            yield from node(e, root.get(XML + "base", base), root.get(XML + "lang", ""))
            del root[:]


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)"""
    r"""|(?P<type>\^\^)|(?P<bnode>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|(?:\d*\.)?\d+(?:[eE][+-]?\d+)?)(?![\w:]))|(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w:%-]|\\.|\.(?=[\w:%-]))*)|(?P<word>[A-Za-z]+)|(?P<mark>[][().;,])|(?P<bad>.)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), s)


def _statements(text: str, base: str) -> Iterator[list[tuple[str, str]]]:
    """The tokens of each statement of a Turtle text: up to a full stop outside brackets, or a directive that needs none. What is no token raises."""
    tokens, depth = [], 0
    for m in _TOKEN.finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind is None:
            continue
        if kind == "bad":
            raise ValueError(f"unexpected {word!r} in {base}")
        if word == "." and kind == "mark" and not depth:
            if tokens:
                yield [*tokens, (kind, word)]
            tokens = []
            continue
        depth += (word in "[(") - (word in ")]") if kind == "mark" else 0
        tokens.append((kind, word))
        if tokens[0][0] == "word" and len(tokens) == {"prefix": 3, "base": 2}.get(tokens[0][1].lower()):
            yield tokens
            tokens = []
    if tokens:
        raise ValueError(f"unfinished statement in {base}")


def turtle(data: bytes, base: str, scope: str, head: bytes = b"", part: int = 0) -> Iterator[Triple]:
    """Triples of a Turtle or N-Triples document, statement by statement; ``head`` holds the directives before a part of one."""
    names, prefixes, out, tokens, at = _Names(scope, part), {}, [], [], 0

    def iri(kind: str, text: str) -> str:
        if kind == "iri":
            return resolved(base, _unescaped(text[1:-1]))
        prefix, _, rest = text.partition(":")
        return prefixes[prefix] + rest.replace("\\", "")

    def term():
        nonlocal at
        kind, text = tokens[at]
        at += 1
        if kind in ("iri", "name"):
            return _node(iri(kind, text))
        if kind == "bnode":
            return _node(names.given(text[2:]))
        if kind in ("str", "long"):
            value = _unescaped(text[3:-3] if kind == "long" else text[1:-1])
            if at < len(tokens) and tokens[at][0] == "lang":
                at += 1
                return _literal(value, lang=tokens[at - 1][1][1:])
            if at < len(tokens) and tokens[at][0] == "type":
                at += 2
                return _literal(value, iri(*tokens[at - 1]))
            return _literal(value)
        if kind == "num":
            return _literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            return _literal(text, XSD + "boolean")
        if text == "[":
            s = names.fresh()
            if tokens[at][1] != "]":
                statements(s)
            at += 1
            return _node(s)
        if text == "(":
            members = []
            while tokens[at][1] != ")":
                members.append(term())
            at += 1
            cells = [names.fresh() for _ in members]
            for cell, rest, member in zip(cells, [*cells[1:], NIL][: len(cells)], members, strict=True):
                out.append((cell, FIRST, *member))
                out.append((cell, REST, *_node(rest)))
            return _node(cells[0] if cells else NIL)
        raise ValueError(f"unexpected {text!r} in {base}")

    def statements(s: str) -> None:
        nonlocal at
        while tokens[at][1] not in (".", "]"):
            if tokens[at][1] == ";":
                at += 1
                continue
            p = TYPE if tokens[at] == ("word", "a") else iri(*tokens[at])
            at += 1
            while True:
                out.append((s, p, *term()))
                if tokens[at][1] != ",":
                    break
                at += 1

    for tokens in _statements(head.decode() + data.decode("utf-8-sig"), base):
        at, (kind, word) = 0, tokens[0]
        if kind in ("word", "lang") and word.lower().lstrip("@") == "prefix":
            prefixes[tokens[1][1][:-1]] = iri(*tokens[2])
        elif kind in ("word", "lang") and word.lower().lstrip("@") == "base":
            base = iri(*tokens[1])
        else:
            subject = term()[1]
            statements(subject)
            yield from out
            out.clear()


def is_xml(data: bytes) -> bool:
    """By content: an RDF/XML document begins with markup, the rest is Turtle (of which N-Triples is a part)."""
    first = data[:4096].replace(b"\0", b"").lstrip(b"\xef\xbb\xbf\xff\xfe \t\r\n")
    return bool(first.startswith((b"<?xml", b"<rdf:", b"<!")) or re.match(rb"<[A-Za-z]+:RDF", first))


def parse(data: bytes, base: str, scope: str, head: bytes = b"", part: int = 0) -> Iterator[Triple]:
    return (rdf_xml if is_xml(head or data) else turtle)(data, base, scope, head, part)


_ARROW = pa.schema(
    [("ontology_id", pa.string()), ("file_rank", pa.int32()), ("seq", pa.int64()), ("s", pa.string()), ("s_bnode", pa.bool_())]
    + [(n, pa.string()) for n in ("p", "o_kind", "o", "datatype", "lang")]
)


def tables(ontology_id: str, file_rank: int, part: int, found: Iterator[Triple]) -> Iterator[pa.RecordBatch]:
    """Triples of a file, or of one part of it, as batches; seq goes by part, then by place."""
    found, seq = iter(found), part << 40
    while some := list(islice(found, 50_000)):
        rows = [(ontology_id, file_rank, seq + i, s, s.startswith("_:"), p, kind, o, datatype, lang) for i, (s, p, kind, o, datatype, lang) in enumerate(some)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        seq += len(some)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from tables(row["ontology_id"], row["file_rank"], 0, parse(row["content"], row["base"], f"{row['ontology_id']}-{row['file_rank']}"))


#: The parts of a line of N-Triples, and what an escape of one character stands for.
_LINE = r"""^\s*(?:<([^>]*)>|_:(\S+))\s*<([^>]*)>\s*(?:<([^>]*)>|_:(\S*[^\s.])|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$"""
_ESCAPED = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)"


def _plain(value: Column) -> Column:
    """A string of N-Triples without its escapes."""

    def one(escape: Column) -> Column:
        mark = F.substring(escape, 2, 1)
        coded = F.decode(F.unhex(F.lpad(F.substring(escape, 3, 8), 8, "0")), "UTF-32")
        short = F.create_map(*[F.lit(x) for pair in _PLAIN.items() for x in pair])
        return F.when((F.length(escape) > 2) & mark.isin("u", "U"), coded).otherwise(F.coalesce(F.try_element_at(short, mark), mark))

    pieces, escapes = F.split(value, _ESCAPED, -1), F.regexp_extract_all(value, F.lit(_ESCAPED), F.lit(0))
    whole = F.array_join(F.zip_with(pieces, escapes, lambda piece, escape: F.concat(piece, F.when(escape.isNull(), F.lit("")).otherwise(one(escape)))), "")
    return F.when(F.contains(value, F.lit("\\")), whole).otherwise(value)


def n_triples(lines: DataFrame) -> DataFrame:
    """Triples of (ontology_id, file_rank, seq, value) lines. Blank lines and comments give none, any other line that is no triple raises."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    fits = F.when(F.col("value").rlike(_LINE), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no triple: "), "value")).cast("boolean"))
    rows = rows.where(fits).select("ontology_id", "file_rank", "seq", *[part(i).alias(n) for i, n in enumerate(("s", "sb", "p", "o", "ob", "text", "lang", "type"), 1)])
    blank = lambda c: F.concat(F.lit("_:"), "ontology_id", F.lit("-"), F.col("file_rank").cast("string"), F.lit("-n-"), c)
    kind = F.when(F.col("ob") != "", "bnode").when(F.col("o") != "", "uri").otherwise("literal")
    datatype = F.when(F.col("type") != "", _plain(F.col("type"))).when(F.col("lang") != "", "").otherwise(XSD + "string")
    return rows.withColumn("o_kind", kind).select(
        "ontology_id", "file_rank", "seq", F.when(F.col("sb") != "", blank("sb")).otherwise(_plain(F.col("s"))).alias("s"), (F.col("sb") != "").alias("s_bnode"), _plain(F.col("p")).alias("p"), "o_kind",
        F.when(F.col("o_kind") == "bnode", blank("ob")).when(F.col("o_kind") == "uri", _plain(F.col("o"))).otherwise(_plain(F.col("text"))).alias("o"),
        F.when(F.col("o_kind") == "literal", datatype).otherwise("").alias("datatype"), "lang",
    )


#: XML and Turtle files up to this many bytes are parsed by one task each.
WHOLE_BYTES = 128 << 20


def triples(spark: SparkSession, files: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Triples of (ontology_id, file_rank, path) rows; file_rank 0 is the ontology's own file, higher ones its imports.

    The list of files is on the driver, as readers take paths, so it is broadcast to the lines. seq follows the order in a file.
    XML and Turtle files of more than ``whole_bytes`` are read by ranges (``rdfranges``).
    """
    paths = [r["path"] for r in files.select("path").distinct().collect()]
    by_line = [p for p in paths if re.search(r"\.nt(?:\.[a-z0-9]+)?$", p)]
    whole = [p for p in paths if p not in set(by_line)]
    files = files.select("ontology_id", F.col("file_rank").cast("int").alias("file_rank"), "path")
    # the store may spell a path with its scheme: they meet on what follows it
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    found = []
    if whole:
        # sizes alone are read here, no contents
        sizes = spark.read.format("binaryFile").load(whole).where(F.col("length") > whole_bytes).select(F.col("path").alias("full"))
        large = files.join(sizes, plain(F.col("path")) == plain(F.col("full"))).select("ontology_id", "file_rank", "path").collect()
        if large:
            found.append(rdfranges.read(spark.createDataFrame(large, "ontology_id string, file_rank int, path string")))
            whole = sorted(set(whole) - {r["path"] for r in large})
    if whole or not (by_line or found):
        content = spark.read.format("binaryFile").load(whole) if whole else spark.createDataFrame([], "path string, content binary")
        met = files.join(content.select(F.col("path").alias("full"), "content"), plain(F.col("path")) == plain(F.col("full")))
        found.append(met.select("ontology_id", "file_rank", F.col("path").alias("base"), "content").mapInArrow(_parsed, SCHEMA))
    if by_line:
        # the parts of a file are read in order: partitions are listed by size, and all but a file's last part are of one size
        lines = spark.read.text(by_line).select("value", F.col("_metadata.file_path").alias("full"), F.monotonically_increasing_id().alias("seq"))
        found.append(n_triples(lines.join(F.broadcast(files), plain(F.col("path")) == F.url_decode(F.replace(plain(F.col("full")), F.lit("+"), F.lit("%2B"))))))
    return reduce(DataFrame.union, found)


def with_imports(spark: SparkSession, files: DataFrame, resolve: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``files`` with every file that owl:imports reaches, and the triples of all of them.

    ``resolve`` maps import IRIs to paths. Each file of an ontology is read once, in the round that finds it, so import cycles end.
    """
    from ontoloom.functions.vocabulary import OWL
    from ontoloom.plans.staging import staged

    seen = {(r["ontology_id"], r["path"]): r["file_rank"] for r in files.collect()}
    read = [staged(triples(spark, files), "triples")]
    while True:
        found = read[-1].where(F.col("p") == OWL + "imports").select("ontology_id", "o").distinct().orderBy("ontology_id", "o").collect()
        rows = []
        for r in found:
            key = (r["ontology_id"], resolve.get(r["o"]))
            if key[1] and key not in seen:
                seen[key] = 1 + max(v for (o, _), v in seen.items() if o == key[0])
                rows.append((*key, seen[key]))
        if not rows:
            break
        read.append(staged(triples(spark, spark.createDataFrame(rows, "ontology_id string, path string, file_rank int")), "triples"))
    every = spark.createDataFrame([(o, n, p) for (o, p), n in seen.items()], "ontology_id string, file_rank int, path string")
    return every, reduce(DataFrame.union, read)


def imports_closure(spark: SparkSession, files: DataFrame, resolve: dict[str, str]) -> DataFrame:
    """The files of ``with_imports``."""
    return with_imports(spark, files, resolve)[0]


def file_times(configs: DataFrame) -> DataFrame:
    """(ontology_id, sourceFileTimestamp): when each ontology's own file (column path) was last changed. Contents are not read."""
    spark = configs.sparkSession
    paths = [r["path"] for r in configs.select("path").where("path is not null").distinct().collect()]  # one an ontology
    if not paths:
        return configs.select("ontology_id", F.lit(None).cast("timestamp").alias("sourceFileTimestamp")).where("false")
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    files = spark.read.format("binaryFile").load(paths).select(bare("path").alias("__file"), "modificationTime")
    named = configs.where("path is not null").select("ontology_id", bare("path").alias("__file"))
    return named.join(files, "__file").groupBy("ontology_id").agg(F.max("modificationTime").alias("sourceFileTimestamp"))
