"""What the operators share: reading Arrow batches in slices of bounded bytes, and the rule that holds rows out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary) of a table with any further columns. Null texts stay null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Row runs of each batch with about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Row runs over batches with about ``limit`` bytes of text, made of parts of an eighth at most; a longer single text is a run of its own."""
    held, size = [], 0
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for part in slices(batches, limit // 8, column):
        own = int(pa.compute.sum(pa.compute.binary_length(part.column(column))).as_py() or 0)
        if held and size + own > limit:
            yield joined()
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield joined()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


def crc_of(key: int | None) -> int | None:
    """crc32 of an id as text."""
    return None if key is None else zlib.crc32(str(key).encode())


def crc_column(doc_id: Column | str) -> Column:
    """The same as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary"))


def text_hash(text: Column | str = "text") -> Column:
    """Hash of a text, null as empty: with doc_id it names a row where ids are null or repeat."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id and text hash are in ``gone`` (doc_id, h)."""
    # rows that go may be a part of all rows, so the plan is a merge of both sides at every size
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_hash")).distinct().hint("merge")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone_id"]) & (text_hash(docs["text"]) == gone["__gone_hash"]), "left_anti")


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
