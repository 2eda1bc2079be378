"""An inverted index with positions: searches read the postings of their tokens only.

A posting says that a token stands at a place of a value of a field of a document. Tokens are kept in four ways, as the match modes of
``operators.search`` cut them: words in lower case (letters and digits), white-space tokens in lower case and as written, and whole values.
Only phrases ask for places. Words are kept with them where a field is searched for phrases; else, like white-space tokens, a document is
kept once for each value that holds the token, without places.
The table is parted by the first signs of a token, and sorted by token within files: a search prunes to the folders of its tokens, and
the files' statistics pass over the other tokens there. Prefixes of a token's first signs lie in one folder too, so a search for tokens
that begin with a text reads as little, unless that text is shorter than these signs.

Postings travel and are kept in lists: a task that cuts texts groups runs of ``BLOCK`` tokens by token, so a row is what one run has of a
token, and no list is longer than a run. Rows are dealt by folder and by a hash of their first document, so a token that very many documents
hold is written by several tasks, more of them where there are more shuffle partitions. Matches are counted by aggregates over
(clause, document, value) that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.operators import search
from ontoloom.operators.search import EDGES, LOWER_TOKENS, PHRASE, SPACE_EDGES, SPACE_TOKENS, TOKENS, WHOLE, SearchSpec
from ontoloom.session import ship_package

#: Words with their places, and without.
WORD, BARE = "word", "bare"
SPACE, CASE, VALUE = "space", "case", "value"
#: Kinds of tokens that answer a match mode, the smallest first.
KINDS = {WHOLE: (VALUE,), TOKENS: (CASE,), LOWER_TOKENS: (BARE, WORD), EDGES: (BARE, WORD), PHRASE: (WORD,), SPACE_TOKENS: (SPACE,), SPACE_EDGES: (SPACE,)}
#: Kinds that keep every place; a whole value stands at 0.
PLACED = (WORD, VALUE)
#: Folders of a table, and the first signs of a token that choose one.
BUCKETS, SIGNS = 64, 3
#: Whole values of more bytes are held by their SHA-256.
LONGEST = 512
#: Tokens that a task groups at once (a single longer value is a run of its own), and rows of a batch that it gives back. A run's fields,
#: tokens and places are packed in numbers of 63 bits, so 2^21 is the most.
BLOCK, BATCH_ROWS = 1 << 21, 4096
#: One shuffle partition in so many takes a part of each folder.
SHARE = 16
#: Tokens of a clause that one mask holds.
MASK = 60


def _bucket(kind: Column, token: Column) -> Column:
    return F.pmod(F.xxhash64(kind, F.substring(token, 1, SIGNS)), F.lit(BUCKETS)).cast("int")


def _held(value: Column) -> Column:
    return F.when(F.octet_length(value) > LONGEST, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)


def _cut(kind: str):
    """A value's tokens in order; an empty one may lead or trail."""
    if kind == VALUE:
        return lambda v: F.array(_held(v))
    if kind == CASE:
        return lambda v: F.split(v, r"\s+")
    return lambda v: F.split(F.lower(v), r"\s+" if kind == SPACE else r"[^\p{L}\p{N}]+")


def _runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Runs of values with ``block`` tokens together at most; a longer value is a run of its own."""
    held, size = [], 0
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + block - size, side="right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += ends[to - 1] - before
                at = to
            if at < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _grouped(blank: list[bool], placed: list[bool], block: int):
    """Rows (slot, value_no, token, ids, places) of runs of values. Of a slot, blank: whether empty tokens count; placed: whether places are kept."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, block):
            lists = run.column("tokens")
            tokens, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
            begins = np.cumsum(lengths) - lengths
            coded = pc.dictionary_encode(tokens)
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            slot, value_no = (run.column(c).to_numpy().astype(np.int64) for c in ("slot", "value_no"))
            empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
            kept = np.flatnonzero((code >= 0) & ((code != empty) | np.asarray(blank)[slot][parent]))
            if not len(kept):
                continue
            numbers = int(value_no.max()) + 1
            of, which = np.unique(slot * numbers + value_no, return_inverse=True)
            # one number holds field, token and place in the run, so that a plain sort leaves a token's places in order
            bits, words = (len(tokens) - 1).bit_length(), len(coded.dictionary)
            packed = which[parent[kept]]
            packed *= words
            packed += code[kept]
            packed <<= bits
            packed |= kept
            packed.sort()
            group, at = packed >> bits, packed & ((1 << bits) - 1)
            value = parent[at]
            held = np.asarray(placed)[slot][value]
            # without places, a value is kept once; its places are neighbours here
            once = held | (np.diff(group, prepend=-1) != 0) | (np.diff(value, prepend=-1) != 0)
            group, at, value, held = group[once], at[once], value[once], held[once]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(first, len(group))
            places_ends = np.append(0, np.cumsum(held))[ends]
            own = of[group[first] // words]
            columns = {
                "slot": pa.array(own // numbers, type=pa.int32()), "value_no": pa.array(own % numbers, type=pa.int32()), "token": coded.dictionary.take(pa.array(group[first] % words)),
                "ids": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), run.column("id").take(pa.array(value))),
                "places": pa.ListArray.from_arrays(pa.array(places_ends, type=pa.int32()), pa.array(at[held] - begins[value[held]], type=pa.int32())),
            }
            rows = pa.RecordBatch.from_pydict(columns)
            for k in range(0, rows.num_rows, BATCH_ROWS):
                yield rows.slice(k, BATCH_ROWS)

    return group


def _schema(id_type: str) -> str:
    return f"value_no int, token string, ids array<{id_type}>, places array<int>"


def postings(documents: DataFrame, fields: dict[str, tuple[str, ...]], key: str = "id", block: int = BLOCK) -> DataFrame:
    """(kind, field, value_no, token, ids, places) of the fields, each with the kinds of tokens it is searched by: a row is what a run of
    documents has of a token in their values of one number, both lists in step, or no places where the kind keeps none. Null values have none."""
    slots = [(name, kind) for name, kinds in fields.items() for kind in dict.fromkeys(kinds)]
    lists = [F.struct(F.lit(slot).alias("slot"), F.transform(search.values_of(documents, name), _cut(kind)).alias("values")) for slot, (name, kind) in enumerate(slots)]
    each = documents.select(F.col(key).alias("id"), F.explode(F.array(*lists)).alias("f")).select("f.slot", "id", F.posexplode("f.values").alias("value_no", "tokens")).where("tokens is not null")
    ship_package(documents.sparkSession)
    rows = each.mapInArrow(_grouped([kind == VALUE for _, kind in slots], [kind in PLACED for _, kind in slots], block), f"slot int, {_schema(documents.schema[key].dataType.simpleString())}")
    of_slot = lambda which: F.get(F.array(*[F.lit(s[which]) for s in slots]), F.col("slot"))
    return rows.select(of_slot(1).alias("kind"), of_slot(0).alias("field"), "value_no", "token", "ids", "places")


@dataclass(frozen=True)
class TextIndex:
    """Postings that were written, and the kinds of tokens by field."""

    rows: DataFrame
    fields: dict[str, tuple[str, ...]]

    def reads(self, spec: SearchSpec) -> bool:
        """Whether the index holds every field and kind that a search of this text needs."""
        text = [c for g in search.clauses(spec) for c in g] + [(n, spec.text, w, how) for n, v, w, how in spec.boosts if v is None]
        return bool(spec.text) and bool(search.clauses(spec)) and all(set(KINDS[how]) & set(self.fields.get(n, ())) for n, _, _, how in text)

    def _kind(self, name: str, how: str) -> str:
        return next((k for k in KINDS[how] if k in self.fields.get(name, ())), KINDS[how][0])

    def hits(self, spec: SearchSpec) -> DataFrame:
        """(id, best: array of the greatest weight by group of clauses, boost) of the documents that some clause matches."""
        groups = search.clauses(spec)
        wanted = [(g, *c) for g, group in enumerate(groups) for c in group]
        wanted += [(len(groups) + b, n, spec.text, w, how) for b, (n, v, w, how) in enumerate(spec.boosts) if v is None]
        parts, buckets, everywhere = [], [], False
        for no, (_, name, text, _, how) in enumerate(wanted):
            kind, begins = self._kind(name, how), how in (EDGES, SPACE_EDGES)
            for k, token in enumerate(search.wanted_tokens(text, how)):
                own = _held(F.lit(token)) if kind == VALUE else F.lit(token)
                is_it = F.col("token").startswith(token) if begins else F.col("token") == own
                everywhere |= begins and len(token) < SIGNS
                buckets.append(_bucket(F.lit(kind), own))
                # a phrase's tokens meet where it would begin, others anywhere in a value
                begin = F.lit(k if how == PHRASE else None).cast("int")
                mask = F.lit(1 << k % MASK).cast("long")
                parts.append(((F.col("kind") == kind) & (F.col("field") == name) & is_it, F.struct(F.lit(no).alias("clause"), F.lit(k // MASK).alias("part"), mask.alias("mask"), begin.alias("begin"))))
        if not parts:
            return self.rows.select(F.get("ids", F.lit(0)).alias("id"), F.array().cast("array<double>").alias("best"), F.lit(0.0).alias("boost")).where("false")
        either = parts[0][0]
        for test, _ in parts[1:]:
            either = either | test
        rows = self.rows.where(either) if everywhere else self.rows.where(F.col("bucket").isin(*buckets) & either)
        fits = F.filter(F.array(*[F.when(test, what) for test, what in parts]), lambda x: x.isNotNull())
        placed = any(how == PHRASE for *_, how in wanted)
        each = F.inline(F.arrays_zip("ids", "places")).alias("id", "place") if placed else F.explode("ids").alias("id")
        rows = rows.select("value_no", "ids", "places", F.explode(fits).alias("c")).select("value_no", "c.*", each)
        rows = rows.withColumn("anchor", F.coalesce(F.col("place") - F.col("begin"), F.lit(-1)) if placed else F.lit(-1))
        needs = [len(search.wanted_tokens(t, how)) for _, _, t, _, how in wanted]
        need = F.element_at(F.array(*map(F.lit, needs)), F.col("clause") + 1)
        seen = [F.bit_count(F.bit_or(F.when(F.col("part") == p, F.col("mask")).otherwise(F.lit(0).cast("long")))) for p in range(-(-max(needs) // MASK))]
        whole = rows.groupBy("id", "clause", "value_no", "anchor").agg(sum(seen[1:], seen[0]).alias("n")).where(F.col("n") == need)
        weight = lambda no: F.lit(float(wanted[no][3]))

        def greatest(group: int) -> Column:
            own = [no for no, c in enumerate(wanted) if c[0] == group]
            found = F.lit(None).cast("double")
            for no in own:
                found = F.when(F.col("clause") == no, weight(no)).otherwise(found)
            return F.coalesce(F.max(found), F.lit(0.0))

        best = [greatest(g).alias(f"g{g}") for g in range(len(groups))]
        boosts = [greatest(g).alias(f"g{g}") for g in range(len(groups), len(groups) + len(spec.boosts))]
        found = whole.groupBy("id").agg(*best, *boosts)
        raised = sum((F.col(f"g{len(groups) + b}") for b in range(len(spec.boosts))), F.lit(0.0))
        return found.select("id", F.array(*[F.col(f"g{g}") for g in range(len(groups))]).cast("array<double>").alias("best"), raised.alias("boost"))

    def search(self, documents: DataFrame, spec: SearchSpec, key: str = "id") -> DataFrame:
        """The rows and scores of ``search.search``, from postings; documents' texts are not looked at.

        Without a text, or where the index lacks a field, all rows are searched. Filters, and boosts of a fixed value, hold on the documents found.
        """
        if not self.reads(spec):
            return search.search(documents, spec)
        kept = search.filtered(documents, spec.filters)
        hits = self.hits(spec).withColumnRenamed("id", "__id").withColumnRenamed("best", "__best").withColumnRenamed("boost", "__boost")
        fixed = [(n, v, w, how) for n, v, w, how in spec.boosts if v is not None]
        more = sum((F.when(search.matches(documents, n, v, how), F.lit(float(w))).otherwise(F.lit(0.0)) for n, v, w, how in fixed), F.col("__boost"))
        best = [F.coalesce(F.get("__best", F.lit(g)), F.lit(0.0)) for g in range(len(search.clauses(spec)))]
        found = kept.join(hits, kept[key] == hits["__id"]).withColumn("score", search.combined(spec, best, more))
        return found.where("score > 0").drop("__id", "__best", "__boost")


def write(documents: DataFrame, fields: dict[str, tuple[str, ...]], path: str, key: str = "id", block: int = BLOCK) -> TextIndex:
    """Index the fields of a table, whose ``key`` tells rows apart, under ``path``. Fields that the table lacks are passed over."""
    there = {n: tuple(k) for n, k in fields.items() if n in documents.columns}
    rows = postings(documents, there, key, block).withColumn("bucket", _bucket(F.col("kind"), F.col("token")))
    spark = documents.sparkSession
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARE)
    rows.repartition("bucket", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(parts))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
    return read(spark, path, there, documents.schema[key].dataType.simpleString())


def read(spark: SparkSession, path: str, fields: dict[str, tuple[str, ...]], id_type: str = "string") -> TextIndex:
    schema = f"kind string, field string, {_schema(id_type)}, bucket int"
    return TextIndex(spark.read.schema(schema).parquet(path), fields)


def kinds_for(*specs: SearchSpec) -> dict[str, tuple[str, ...]]:
    """The fields and kinds of tokens that searches like these need; words with places serve searches without them too."""
    out: dict[str, dict] = {}
    for spec in specs:
        for name, how in [(n, WHOLE if spec.exact else how) for n, _, how in spec.fields] + [(n, how) for n, v, _, how in spec.boosts if v is None]:
            out.setdefault(name, {})[KINDS[how][0]] = None
    return {n: tuple(k for k in kinds if k != BARE or WORD not in kinds) for n, kinds in out.items()}
