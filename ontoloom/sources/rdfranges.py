"""Large RDF/XML and Turtle files, cut into byte ranges that are parsed side by side.

``cut(files)`` scans each file once, in a task of its own and in bounded memory: an XML parser without a tree gives the bytes where top-level
elements begin, a scan over strings, IRIs, comments and brackets the bytes where statements of Turtle end. Each range comes with the head that makes
it a document of its own: the prolog and root element, or the prefixes and base in force. ``read`` deals the ranges over tasks, each of which reads
no more than its own. Triples are those of the whole file, in its order; only the made-up names of blank nodes differ.
Files are opened through ``pyarrow.fs``, so by paths or by URIs of the stores it knows.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.vocabulary import RDF
from ontoloom.plans.staging import staged

#: About how many bytes a range has, how many are read at a time, and how many tasks read ranges at most.
RANGE_BYTES, READ_BYTES, MAX_TASKS = 32 << 20, 1 << 20, 20_000
Range = tuple[int, int, bytes]  # first byte, byte past the last, head

_RANGES = pa.schema(
    [("ontology_id", pa.string()), ("file_rank", pa.int32()), ("path", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("head", pa.binary())]
)
RANGES = "ontology_id string, file_rank int, path string, part int, start long, stop long, head binary"


def opened(path: str) -> pa.NativeFile:
    """A file by local path or URI, for reading at any place."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    else:
        store, name = fs.LocalFileSystem(), path
    return store.open_input_file(name)


def xml_ranges(file: pa.NativeFile, size: int) -> Iterator[Range]:
    """Ranges of whole top-level elements. A document whose root is no rdf:RDF is one node, so one range without a head."""
    parser = expat.ParserCreate(namespace_separator=" ")
    starts: list[int] = []
    depth = whole = end = 0

    def opens(name: str, _: dict) -> None:
        nonlocal depth, whole
        if depth == 0:
            whole = name != f"{RDF} RDF"
        elif depth == 1 and not whole and (not starts or parser.CurrentByteIndex - starts[-1] >= size):
            starts.append(parser.CurrentByteIndex)
        depth += 1

    def closes(_: str) -> None:
        nonlocal depth, end
        depth -= 1
        end = parser.CurrentByteIndex if depth == 0 else end

    parser.StartElementHandler, parser.EndElementHandler = opens, closes
    head, seen = bytearray(), 0
    while data := file.read(READ_BYTES):
        if not starts:
            head += data
        parser.Parse(data, False)
        seen += len(data)
        if starts and len(head) > starts[0]:
            del head[starts[0] :]
        while len(starts) > 1:
            yield starts[0], starts[1], bytes(head)
            del starts[0]
        if whole:
            head.clear()
    parser.Parse(b"", True)
    if whole:
        yield 0, seen, b""
    while starts:
        yield starts[0], starts[1] if len(starts) > 1 else end, bytes(head)
        del starts[0]


#: What a statement's end can't lie in, what brackets do to the depth, and full stops. What is none of these is not closed yet.
_SPAN = re.compile(
    r"""(?P<plain>(?:[^<"'#.\[\]()\\@]++|\\.|<[^>]*>|\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|(?!\"\"\")"(?:[^"\\\n]|\\.)*"|(?!\'\'\')'(?:[^'\\\n]|\\.)*')++)"""
    r"""|(?P<other>\#[^\n]*|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<up>[\[(])|(?P<down>[\])])|(?P<stop>\.)|(?P<open>.)""",
    re.DOTALL,
)
_GAP = r"(?:\s|\#[^\n]*\n)"
_DIRECTIVE = re.compile(rf"{_GAP}*+@?(?:(?i:prefix){_GAP}++(?P<name>[^\s:<]*):|(?i:base)(?![\w:])){_GAP}*+<(?P<iri>[^>]*)>(?:{_GAP}*+\.)?")
_INSIDE = re.compile(r"[\w:%\\-]")


def turtle_ranges(file: pa.NativeFile, size: int, base: str) -> Iterator[Range]:
    """Ranges of whole statements. Prefixes and bases are gathered on the way, with those that stand in their place later on."""
    from ontoloom.sources.rdf import _unescaped, resolved

    decoder = codecs.getincrementaldecoder("utf-8")()
    prefixes: dict[str, str] = {}
    first = file.read(3)
    at = 3 if first == codecs.BOM_UTF8 else 0  # the byte where ``text`` begins
    text, ended = "" if at else decoder.decode(first), False
    before = base

    def told() -> bytes:
        safe = lambda iri: re.sub(r"[\\>]", lambda m: f"\\u{ord(m[0]):04X}", iri)
        return "".join([f"@base <{safe(before)}> .\n", *[f"@prefix {n}: <{safe(i)}> .\n" for n, i in prefixes.items()]]).encode()

    start, head, want = at, told(), READ_BYTES
    while True:
        data = b"" if ended else file.read(want)
        ended = not data
        text += decoder.decode(data, ended)
        # ``done`` is where the last whole statement ends, ``at`` the same place in the file; what lies behind it is scanned anew with more text
        done, depth, pos, last, fresh = 0, 0, 0, "", True
        while pos < len(text):
            if fresh and (m := _DIRECTIVE.match(text, pos)):
                if m.end() == len(text) and not ended:
                    break
                iri = resolved(before, _unescaped(m["iri"]))
                if m["name"] is None:
                    before = iri
                else:
                    prefixes[m["name"]] = iri
                at += len(text[done : m.end()].encode())
                done = pos = m.end()
                continue
            fresh = False
            m = _SPAN.match(text, pos)
            kind, end = m.lastgroup, m.end()
            if (end == len(text) and not ended) or kind == "open":
                break
            if kind == "stop":
                after = text[end : end + 1]
                inside = last == "plain" and _INSIDE.match(text[pos - 1]) and _INSIDE.match(after)
                if not (depth or after.isdigit() or inside):
                    at += len(text[done:end].encode())
                    done, fresh = end, True
                    if at - start >= size:
                        yield start, at, head
                        start, head = at, told()
            else:
                depth += (kind == "up") - (kind == "down")
            last, pos = kind, end
        text = text[done:]
        if ended:
            break
        # a statement longer than what was read is scanned anew with twice as much, so its cost stays linear
        want = READ_BYTES if done else max(READ_BYTES, len(text))
    yield start, at + len(text.encode()), head


def _cut(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ontoloom.sources.rdf import is_xml

        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    xml = is_xml(file.read(4096))
                    file.seek(0)
                    found = xml_ranges(file, size) if xml else turtle_ranges(file, size, row["path"])
                    for part, (start, stop, head) in enumerate(found):
                        cells = (row["ontology_id"], row["file_rank"], row["path"], part, start, stop, head)
                        yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(cells, _RANGES, strict=True)], schema=_RANGES)

    return task


def cut(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(ontology_id, file_rank, path, part, start, stop, head) of (ontology_id, file_rank, path) rows; parts follow the order of the file."""
    spread = files.repartition(min(files.count(), MAX_TASKS) or 1)
    return spread.select("ontology_id", F.col("file_rank").cast("int").alias("file_rank"), "path").mapInArrow(_cut(size), RANGES)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from ontoloom.sources.rdf import parse, tables

    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["path"]) as file:
                file.seek(row["start"])
                data = file.read(row["stop"] - row["start"])
            scope = f"{row['ontology_id']}-{row['file_rank']}"
            yield from tables(row["ontology_id"], row["file_rank"], row["part"], parse(data, row["path"], scope, row["head"], row["part"]))


def read(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Triples of (ontology_id, file_rank, path) rows, by ranges. The ranges are staged: files are scanned once, whatever is done with the triples."""
    from ontoloom.sources.rdf import SCHEMA

    ranges = staged(cut(files, size), "ranges")
    return ranges.repartition(min(ranges.count(), MAX_TASKS) or 1).mapInArrow(_parsed, SCHEMA)
