"""The corpus operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import ctw, exact, langid, mixing, negatives, packing, periodic, pii, repair, secrets, simhash, warc, winnow
from ontoloom.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    classes = exact.exact_classes(docs)
    # the classes need whole-text hashes of open groups only; the digest of the others is this query's own column
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    open_ = classes.where("content_hash is not null").select("doc_id", "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))
    known = open_.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("h")).distinct()
    rest = digest.join(known, digest["doc_id"].eqNullSafe(known["id"]) & (digest["text_sha256"] == known["h"]), "left_anti")
    return rest.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256").union(open_)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_predict(_table(spark, sf_dir, "documents"))


def op8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.scratch_path(spark)
    repair.write_ids(_table(spark, sf_dir, "documents"), path)
    return repair.read_ids(spark, path)


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"), ctw.DEPTH)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A second copy with known faults, by id: of every 97 pages one has a byte changed, one is lost and one has its address cut."""
    k = F.pmod(F.col("page_id"), F.lit(97))
    html = F.when(k == 3, F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    url = F.when(k == 31, F.substring("url", 1, 7)).otherwise(F.col("url"))
    return pages.where(~F.coalesce(k == 59, F.lit(False))).select("page_id", url.alias("url"), html.alias("html"))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    damage, _ = warc.audit(pages, damaged_replica(pages))
    return damage.select("page_id", "shard", "slot", "expected", "found", "state")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of all documents, where one in ten, by its id's checksum, has words that repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n = F.size("words").cast("long")
    a = F.col("g") % n
    rows = rows.select("doc_id", "text", "words", F.when(n > 0, a).alias("a"), F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("g") % 8))).alias("p"))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform("words", lambda w, i: F.get("words", source(i.cast("long")).cast("int")))
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text").cast("string")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(looped(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select("*", periodic.longest().alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(rows, vec_id % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_simhash, op2_best_fit, op3_pii, op4_exact_dedup, op5_winnowing, op6_secrets, op7_ppm_language, op8_repair, op9_ctw, op10_merkle_audit, op11_periodic, op12_mixing, op13_hard_negatives, pipeline]
    return {f.__name__: f for f in own}


# Record bytes are those of warc.record; faults those of damaged_replica.
_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce({url}, '') || chr(13) || chr(10)
|| 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || cast(strlen(coalesce({html}, '')) as varchar) || chr(13) || chr(10) || chr(13) || chr(10)
|| coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)"""


def oracle_sql() -> dict[str, str]:
    damaged = {
        "url": "case when page_id % 97 = 31 then substring(url, 1, 7) else url end",
        "html": "case when page_id % 97 = 3 then '~' || substring(html, 2) else html end",
    }
    return {
        "op4_exact_dedup": """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)""",
        "op12_mixing": """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size,
 case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from d group by source),
c as (select *, 1.5::double * sum(source_size) over () as wanted, sum(weight) over () as weights,
 coalesce(sum(source_size) over w, 0) as held, coalesce(sum(weight) over w, 0) as full_weight
 from s window w as (order by 2::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select max(level) as level from (select (wanted - 2::double * held) / (weights - full_weight) as level, weight, source_size from c)
 where level * weight <= 2::double * source_size),
t as (select source, source_size, least(coalesce(level, 0) * weight, 2::double * source_size) as target,
 cast('0x' || substring(md5('7' || coalesce(':' || source, '')), 1, 8) as bigint) / 4294967296::double as start from s, l),
e as (select *, case when source_size > 0 then target / source_size else 0::double end as expected from t),
r as (select d.doc_id, d.size, e.*, row_number() over (partition by d.source order by d.size, d.doc_id nulls last) - 1 as place
 from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, cast(size * (floor(expected) + floor(start + (expected - floor(expected)) * (place + 1))
 - floor(start + (expected - floor(expected)) * place)) as bigint) as taken from r""",
        "op13_hard_negatives": """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
 from embeddings where vec_id is not null and label is not null and embedding is not null
 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
 from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score, cast(row_number() over (partition by anchor_id order by score desc, other) as integer) as positive_rank
 from s where same qualify positive_rank <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_rank order by score desc, other) as integer) as rank,
 other as negative_id, positive_score, score as negative_score, positive_rank
from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5""",
        "op10_merkle_audit": f"""
with p as (select page_id, sha256({_RECORD.format(url="url", html="html")}) as expected from pages),
r as (select page_id, sha256({_RECORD.format(**damaged)}) as found from pages where page_id % 97 <> 59)
select page_id, page_id // 4096 as shard, cast(page_id % 4096 as integer) as slot, expected, found,
case when found is null then 'missing' else 'damaged' end as state
from p left join r using (page_id) where found is distinct from expected""",
    }
