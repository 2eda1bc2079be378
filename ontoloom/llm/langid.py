"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts, orders 0 to 4. A symbol costs -log2 c/(C+D) where its context has seen it (C: the
context's count, D: its distinct symbols), else the escape -log2 D/(C+D) and then what the next shorter context charges; an
unseen context charges nothing by itself, and below order 0 a byte costs 8 bits. Counts are frozen after the fit, so a text's
code length is a sum over its windows of five bytes. The language with the shortest code is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.batches import crc_column, emit, slices, texts_of
from ontoloom.plans.staging import staged

ORDER = 4
#: Rows of text a language learns from, about (taken by a hash of doc_id and text).
ROWS_PER_LANG = 3000
#: Windows of one model, and windows times languages (its cells of four bytes), about: languages past these are learned and scored in a
#: further pass. One language is never divided.
SHARD_WINDOWS, SHARD_CELLS = 1_000_000, 16_000_000
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_COUNT = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed five-byte windows, the newest byte lowest, of all texts (each begins after four zero bytes), and their counts by text."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(b"\0\0\0\0" + t for t in texts), dtype=np.uint8).astype(np.uint64)
    keys = flat[4:].copy() if len(flat) > 4 else np.empty(0, dtype=np.uint64)
    for back in range(1, 5):
        keys |= flat[4 - back : len(flat) - back] << np.uint64(8 * back)
    inside = np.ones(len(flat), dtype=bool)
    heads = np.cumsum(counts + 4) - (counts + 4)
    inside[(heads[:, None] + np.arange(4)).ravel()] = False
    return keys[inside[4:]], counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 4 << 20):
        langs, texts = part.column("lang").to_pylist(), texts_of(part)
        for lang in sorted(set(langs)):
            keys, n = np.unique(windows([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
            yield emit(_COUNT, lang=[lang] * len(keys), key=keys.astype(np.int64), n=n)


class Model:
    """Frozen statistics of all languages, compiled to the code length of each window that any of them has seen."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        trees = [self._tree(*counts[lang]) for lang in self.langs]
        self.keys, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1 if trees else 0):
            keys = np.unique(np.concatenate([t[k][0] for t in trees]))
            contexts = np.unique(keys >> np.uint64(8))
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.escapes.append(np.stack([self._find(t[k][2], t[k][3], contexts, 0.0) for t in trees], axis=1).astype(np.float32))
            below = self._below(k, keys)
            cost = [np.where((own := self._find(t[k][0], t[k][1], keys, np.nan)) == own, own, below[:, i]) for i, t in enumerate(trees)]
            self.costs.append(np.stack(cost, axis=1).astype(np.float32))

    @staticmethod
    def _tree(keys: np.ndarray, counts: np.ndarray):
        """For each order: windows, their cost where seen, contexts, their escape cost."""
        out = []
        for k in range(ORDER + 1):
            own, inverse = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(inverse, weights=counts)
            contexts, inverse = np.unique(own >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(inverse, weights=n), np.bincount(inverse)
            out.append((own, -np.log2(n / (total + distinct)[inverse]), contexts, -np.log2(distinct / (total + distinct))))
        return out

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def _below(self, k: int, windows_: np.ndarray) -> np.ndarray:
        """Cost by language of windows that order k has not seen: the escape and what order k - 1 charges."""
        at = np.minimum(np.searchsorted(self.contexts[k], windows_ >> np.uint64(8)), len(self.contexts[k]) - 1)
        known = self.contexts[k][at] == windows_ >> np.uint64(8)
        escape = np.where(known[:, None], self.escapes[k][at], 0)
        return escape + (self.cost(windows_ & np.uint64((1 << 8 * k) - 1), k - 1) if k else 8.0)

    def cost(self, windows_: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits by window (of k + 1 bytes) and language."""
        at = np.minimum(np.searchsorted(self.keys[k], windows_), len(self.keys[k]) - 1)
        out = self.costs[k][at].astype(np.float32)
        if (new := np.flatnonzero(self.keys[k][at] != windows_)).size:
            out[new] = self._below(k, windows_[new])
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits by text and language."""
        keys, counts = windows(texts)
        out = np.zeros((len(texts), len(self.langs)))
        if len(keys) and self.langs:
            own, inverse = np.unique(keys, return_inverse=True)
            cost, filled = self.cost(own), np.flatnonzero(counts)
            starts = np.cumsum(counts[filled]) - counts[filled]
            for i in range(len(self.langs)):
                out[filled, i] = np.add.reduceat(cost[:, i][inverse].astype(np.float64), starts)
        return out


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """One model of all languages, from rows with text and lang."""
    counts, shards = _learned(docs, rows_per_lang)
    return _model(counts, [lang for langs in shards for lang in langs])


def fit_shards(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Iterator[Model]:
    """Models of all languages in order, each of about SHARD_WINDOWS windows; one is built at a time."""
    counts, shards = _learned(docs, rows_per_lang)
    for langs in shards:
        yield _model(counts, langs)


def _learned(docs: DataFrame, rows_per_lang: int) -> tuple[DataFrame, list[list[str]]]:
    """All windows of each language's sample (lang, key, n), counted by Spark, and the languages dealt to shards in order."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows_of_lang"))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.withColumn("unit", unit).join(F.broadcast(sizes), "lang").where(F.col("unit") < F.lit(float(rows_per_lang)) / F.col("rows_of_lang"))
    sample = sample.select("lang", F.lower(F.col("text").cast("string")).cast("binary").alias("text"))
    counts = sample.mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = staged(counts, "ppm-counts")
    shards, held = [], 0
    for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect():
        shards.append((r["lang"], r["n"]))
    out: list[list[str]] = []
    for lang, n in sorted(shards):
        if not out or held + n > SHARD_WINDOWS or (held + n) * (len(out[-1]) + 1) > SHARD_CELLS:
            out.append([])
            held = 0
        out[-1].append(lang)
        held += n
    return counts, out


def _model(counts: DataFrame, langs: list[str]) -> Model:
    if not langs:
        return Model({})
    got = counts.where(F.col("lang").isin(*langs)).toArrow().combine_chunks()
    lang, key, n = np.asarray(got.column("lang").to_pylist(), dtype=object), got.column("key").to_numpy().astype(np.uint64), got.column("n").to_numpy().astype(float)
    return Model({x: (key[at], n[at]) for x in langs for at in [np.flatnonzero(lang == x)]})


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter of any script."""
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, models: Model | Iterable[Model], keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with lang_pred, score and bits_per_byte for every row, from whole texts alone.

    Null, empty and letterless texts get ``und`` and score 0; with no learned language every text does. A tie goes to the
    language first in order. bits_per_byte is the best language's code length, null for an empty text. Each model is a pass
    over the texts that carries the best language so far, so languages may be as many as they are.
    """
    nothing = [F.lit(None).cast("string").alias("__best"), F.lit(None).cast("double").alias("__low"), F.lit(0.0).alias("__total")]
    rows = docs.select(*(F.col(f"`{n}`") for n in keep), F.lower(F.col("text").cast("string")).cast("binary").alias("__text"), *nothing)
    held = None
    for model in [models] if isinstance(models, Model) else models:
        if held is not None:
            rows = staged(_passed(rows, held, keep, last=False), "ppm-pass")
        held = model
    return _passed(rows, held or Model({}), keep, last=True)


def _passed(rows: DataFrame, model: Model, keep: tuple[str, ...], last: bool) -> DataFrame:
    """Best language, its bits, and the sum of 2^(best - bits) over languages, with those of one more model; after the last one, what they say."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    between = pa.schema([("__text", pa.binary()), ("__best", pa.string()), ("__low", pa.float64()), ("__total", pa.float64())])
    final = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, column="__text"):
            texts, low = texts_of(part, "__text"), np.array([np.inf if x is None else x for x in part.column("__low").to_pylist()])
            best, total = part.column("__best").to_pylist(), part.column("__total").to_numpy()
            if m.langs:
                bits, before = m.code_lengths(texts), low
                least, at = bits.min(axis=1), bits.argmin(axis=1)
                low = np.minimum(before, least)
                total = total * np.exp2(low - before) + np.exp2(np.minimum(low[:, None] - bits, 0)).sum(axis=1)
                best = [m.langs[i] if x < b else old for i, x, b, old in zip(at, least, before, best, strict=True)]
            same = part.select(list(keep))
            if not last:
                yield _beside(same, between, __text=part.column("__text"), __best=best, __low=low, __total=total)
                continue
            known = [b is not None and has_letter(t) for b, t in zip(best, texts, strict=True)]
            yield _beside(
                same,
                final,
                lang_pred=[b if ok else UNKNOWN for b, ok in zip(best, known, strict=True)],
                score=[1 / s if ok else 0.0 for s, ok in zip(total, known, strict=True)],
                bits_per_byte=[b / len(t) if t and x is not None else None for x, b, t in zip(best, low, texts, strict=True)],
            )

    out = rows.select(*(F.col(f"`{n}`") for n in keep)).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double")) if last else (("__text", "binary"), ("__best", "string"), ("__low", "double"), ("__total", "double")):
        out = out.add(name, kind)
    return rows.mapInArrow(run, out)


def _beside(same: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    new = emit(schema, **columns)
    return pa.RecordBatch.from_arrays([*same.columns, *new.columns], schema=pa.schema([*same.schema, *schema]))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id mod 4 is 2, or no id."""
    return F.coalesce(crc_column(doc_id) % 4 == 2, F.lit(True))


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for every row, learned from the rows that are not held out."""
    rows = _labelled(docs)
    return predict(rows.select("doc_id", "text", held_out().alias("held_out")), fit_shards(rows.where(~held_out())), ("doc_id", "held_out"))


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


#: A text that the best language model codes no shorter than its plain bytes is in none of the learned languages.
PLAIN_BITS = 8.0


def keep_known_language(docs: DataFrame) -> DataFrame:
    """The documents in a learned language; ``und`` and texts that no learned model compresses go.

    Each row is judged by its own text and carried along whole, so no rows are joined: nulls, repeated ids and repeated rows stay what
    they are. Without learned languages no document stays; an empty table stays empty.
    """
    learn = _labelled(docs)
    cols = [f"c{k}" for k in range(len(docs.columns))]  # names of documents may be those of the answer
    found = predict(docs.withColumn("__own", F.col("text")).toDF(*cols, "text"), fit_shards(learn.where(~held_out())), tuple(cols))
    known = found.where((F.col("lang_pred") != UNKNOWN) & (F.coalesce("bits_per_byte", F.lit(0.0)) < PLAIN_BITS))
    return known.select(*[F.col(c).alias(n) for c, n in zip(cols, docs.columns, strict=True)])
