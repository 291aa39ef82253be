"""Queries over the driver's tables, and the same in SQL. Documents stand for byte tensors in files named by their source, embeddings
for float tensors in files by label, events for measurements."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import convert, model
from .functions import dtypes, scalars
from .operators import catalog as ops
from .operators import measure, validate
from .plans import partition
from .sources import flat, indexed, sinks
from .sources.files import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_tensors(spark: SparkSession, d: str) -> DataFrame:
    """model, name, dtype, shape, stride, size, file_index, path. A file's index is its rank among the sources, which are few beside the documents."""
    docs = _t(spark, d, "documents").select(F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name"), "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    files = docs.select("source").distinct().withColumn("file_index", (F.row_number().over(Window.orderBy("source")) - 1).cast("int"))
    shape = F.array("size")
    return docs.join(files, "source").select(F.lit("documents").alias("model"), "name", F.lit("u8").alias("dtype"), shape.alias("shape"), scalars.contiguous_stride(shape).alias("stride"), "size", "file_index", F.col("source").alias("path"))


def emb_tensors(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select(F.concat(F.lit("emb."), F.col("vec_id").cast("string")).alias("name"), F.array(F.size("embedding").cast("long")).alias("shape"), F.col("label").alias("file_index"))
    return e.select(F.lit("embeddings").alias("model"), "name", F.lit("f32").alias("dtype"), "shape", scalars.contiguous_stride(F.col("shape")).alias("stride"), (scalars.elements(F.col("shape")) * 4).alias("size"), "file_index", F.concat(F.lit("label"), F.col("file_index").cast("string")).alias("path"))


def measurements(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").where(F.col("value").isNotNull() & ~F.isnan("value"))
    backend = F.element_at(F.array(F.lit("sync"), F.lit("async"), F.lit("default")), (F.col("event_id") % 3 + 1).cast("int"))
    error = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("exit "), (F.col("event_id") % 5).cast("string")))
    return e.select(F.col("event_id"), F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")).alias("model"), F.col("event_type").alias("format"), backend.alias("backend"), F.col("value").alias("time_ms"), error.alias("error"))


_DOC = "(SELECT 'doc.' || doc_id AS name, source, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS f FROM documents)"
_EMB = "(SELECT 'emb.' || vec_id AS name, CAST(len(embedding) AS BIGINT) AS n, 4 * CAST(len(embedding) AS BIGINT) AS size, label AS f FROM embeddings)"
_EV = "(SELECT event_id, 'm' || (user_id % 6) AS model, event_type AS format, ['sync', 'async', 'default'][event_id % 3 + 1] AS backend, value AS time_ms, CASE WHEN event_id % 17 = 0 THEN 'exit ' || (event_id % 5) END AS error FROM events WHERE value IS NOT NULL AND NOT isnan(value))"


def _lpt(table: str, n: int) -> str:
    return f"""t AS (SELECT row_number() OVER (ORDER BY size DESC, name) AS k, name, size, f FROM {table}),
step AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(list_transform(range({n}), lambda p: 0) AS BIGINT[]) AS b, CAST(list_transform(range({n}), lambda p: []) AS BIGINT[][]) AS fs, CAST(NULL AS BIGINT) AS pid, CAST(NULL AS BIGINT) AS off
  UNION ALL
  SELECT k, list_transform(range({n}), lambda p: CASE WHEN p = pick THEN b[p + 1] + size ELSE b[p + 1] END),
         list_transform(range({n}), lambda p: CASE WHEN p = pick THEN list_distinct(list_append(fs[p + 1], f)) ELSE fs[p + 1] END), pick, b[pick + 1]
  FROM (SELECT t.k, t.size, CAST(t.f AS BIGINT) AS f, s.b, s.fs, list_min(list_transform(range({n}), lambda p: {{'b': s.b[p + 1], 'n': CASE WHEN list_contains(s.fs[p + 1], CAST(t.f AS BIGINT)) THEN 0 ELSE 1 END, 'p': p}})).p AS pick
        FROM step s JOIN t ON t.k = s.k + 1)),
planned AS (SELECT t.name, t.size, t.f, CAST(s.pid AS INTEGER) AS partition_id, s.off AS dest_offset FROM step s JOIN t USING (k))"""


@query(f"""SELECT name, 'u8' AS dtype, CAST(size AS VARCHAR) AS shape, '1' AS stride, size, f AS file_index FROM {_DOC}
UNION ALL SELECT name, 'f32', CAST(n AS VARCHAR), '1', size, CAST(f AS INTEGER) FROM {_EMB}""")
def tensor_catalog(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return doc_tensors(spark, d).unionByName(emb_tensors(spark, d)).select("name", "dtype", text("shape"), text("stride"), "size", F.col("file_index").cast("int"))


@query(f"SELECT name, size FROM {_DOC} WHERE name IN ('doc.7', 'doc.42', 'doc.199', 'absent')")
def catalog_lookup(spark, d):
    asked = spark.createDataFrame([("doc.7",), ("doc.42",), ("doc.199",), ("absent",)], "name string")
    return ops.lookup(doc_tensors(spark, d), F.broadcast(asked)).select("name", "size")


@query("SELECT 'doc.' || doc_id AS name FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def catalog_missing(spark, d):
    asked = _t(spark, d, "labels").select(F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name"))
    return ops.missing(doc_tensors(spark, d).where("path = 'src0'"), asked)


@query(f"SELECT f AS file_index, name, CAST(row_number() OVER (PARTITION BY f ORDER BY name) - 1 AS INTEGER) AS place FROM {_DOC}")
def names_sorted_rank(spark, d):
    return ops.names_ranked(doc_tensors(spark, d), "file_index")


@query(f"SELECT f AS file_index, CAST(sum(size) AS BIGINT) AS n_bytes, count(*) AS n_tensors FROM {_DOC} GROUP BY 1")
def file_bytes(spark, d):
    return ops.file_bytes(doc_tensors(spark, d))


@query("SELECT name, n FROM (SELECT name, count(*) AS n FROM (SELECT 'doc.' || doc_id AS name FROM documents UNION ALL SELECT 'doc.' || doc_id FROM labels) GROUP BY 1) WHERE n > 1")
def duplicate_names(spark, d):
    return ops.duplicates(doc_tensors(spark, d), _t(spark, d, "labels").select(F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name")))


_SPELLINGS = ("F32", "f", "D", "b", "BOOL", "bf16", "U64", "i8", "half", "c64")


@query("SELECT s AS spelling, o AS part, CASE lower(s) WHEN 'b' THEN 'bool' WHEN 'f' THEN 'f32' WHEN 'd' THEN 'f64' ELSE CASE WHEN lower(s) IN ('bool','u8','i8','i16','u16','f16','bf16','f32','i32','u32','f64','i64','u64') THEN lower(s) END END AS dtype, CASE lower(s) WHEN 'f32' THEN 4 WHEN 'f' THEN 4 WHEN 'd' THEN 8 WHEN 'b' THEN 1 WHEN 'bool' THEN 1 WHEN 'bf16' THEN 2 WHEN 'u64' THEN 8 WHEN 'i8' THEN 1 END AS width FROM (SELECT p_partkey AS o, ['F32','f','D','b','BOOL','bf16','U64','i8','half','c64'][p_partkey % 10 + 1] AS s FROM part)")
def dtype_normalise(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("part"), F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("p_partkey") % 10 + 1).cast("int")).alias("spelling"))
    return p.select("spelling", "part", dtypes.canonical(F.col("spelling")).alias("dtype"), dtypes.width(F.col("spelling")).alias("width"))


@query("SELECT p_partkey AS part, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN '1' WHEN p_size % 4 = 2 THEN '3,1' ELSE (3 * (p_size % 5)) || ',' || (p_size % 5) || ',1' END AS stride, CAST(CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN p_size WHEN p_size % 4 = 2 THEN p_size * 3 ELSE p_size * 3 * (p_size % 5) END AS BIGINT) AS elements FROM part")
def stride_calc(spark, d):
    n = F.col("p_size").cast("long")
    shape = F.slice(F.array(n, F.lit(3).cast("long"), n % 5), F.lit(1), (n % 4).cast("int"))
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("part"), shape.alias("shape"))
    return p.select("part", F.array_join(scalars.contiguous_stride(F.col("shape")).cast("array<string>"), ",").alias("stride"), scalars.elements(F.col("shape")).alias("elements"))


@query("SELECT p_partkey AS part, lower(replace(p_brand || '/' || p_name, '/', '-')) AS slug, substring(sha256(p_name || ':' || p_brand || ':' || p_size || ':' || (p_partkey % 9) || ':v3'), 1, 16) AS cache_key FROM part")
def slug_and_cache_key(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("part"), scalars.slug(F.concat_ws("/", "p_brand", "p_name")).alias("slug"), scalars.cache_key(F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.col("p_partkey") % 9).alias("cache_key"))


@query("SELECT o_orderkey AS id, greatest(1, (CAST(floor(o_totalprice) AS BIGINT) * 100000 + 536870911) // 536870912) AS partitions, 'tensor.data_' || (o_orderkey % 7) AS file FROM orders")
def auto_partition_count(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.auto_partitions(F.floor("o_totalprice").cast("long") * 100000).alias("partitions"), scalars.partition_file(F.col("o_orderkey") % 7).alias("file"))


@query("SELECT o_orderkey AS id, s AS size, CASE WHEN CAST(a AS HUGEINT) + s <= 9223372036854775807 THEN CAST(CAST(a AS HUGEINT) + s AS BIGINT) END AS stop FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 9223372036854775000 ELSE o_orderkey * 10 END AS a, CAST(o_custkey AS BIGINT) AS s FROM orders)")
def checked_ends(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(9223372036854775000)).otherwise(F.col("o_orderkey") * 10).alias("offset"), F.col("o_custkey").alias("size"))
    return o.select("id", "size", scalars.checked_end(F.col("offset"), F.col("size")).alias("stop"))


@query("SELECT p_partkey AS part, CAST(CASE WHEN p_size % 5 = 0 THEN 0.70 WHEN p_size % 5 = 1 THEN 0.50 WHEN p_size % 5 = 2 THEN 0.95 WHEN p_size % 5 = 3 THEN 0.15 ELSE 0.95 END AS DOUBLE) AS share FROM part")
def memory_share(spark, d):
    ids = F.element_at(F.array(*map(F.lit, ("Org/M-8B", "Org/M-14b", "Org/M-32B", "Org/M-70b", "Org/M-4B"))), F.col("p_size") % 5 + 1)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("part"), scalars.memory_share(ids).alias("share"))


for _n in (4, 8):
    QUERIES[f"lpt_plan_{_n}"] = lambda spark, d, n=_n: partition.plan(doc_tensors(spark, d), n).select("name", "size", "file_index", "partition_id", "dest_offset")
    ORACLES[f"lpt_plan_{_n}"] = f"WITH RECURSIVE {_lpt(_DOC, _n)} SELECT name, size, f AS file_index, partition_id, dest_offset FROM planned"


@query(f"WITH RECURSIVE {_lpt(_EMB, 3)} SELECT name, size, CAST(f AS INTEGER) AS file_index, partition_id, dest_offset FROM planned")
def lpt_plan_ties(spark, d):
    return partition.plan(emb_tensors(spark, d), 3).select("name", "size", F.col("file_index").cast("int"), "partition_id", "dest_offset")


_STATS = """SELECT CAST(sum(size) AS BIGINT) AS total_bytes, CAST(max(f) + 1 AS BIGINT) AS source_file_count, CAST(4 AS BIGINT) AS partition_count, count(*) AS tensor_count,
(SELECT CAST(max(b) AS BIGINT) FROM (SELECT sum(size) AS b FROM planned GROUP BY f)) AS max_source_file_bytes, CAST(sum(size) // (max(f) + 1) AS BIGINT) AS mean_source_file_bytes,
(SELECT CAST(max(b) AS BIGINT) FROM (SELECT sum(size) AS b FROM planned GROUP BY partition_id)) AS max_partition_bytes, CAST(sum(size) // 4 AS BIGINT) AS mean_partition_bytes,
(SELECT CAST(sum(c) AS DOUBLE) / 4 FROM (SELECT count(DISTINCT f) AS c FROM planned GROUP BY partition_id)) AS mean_source_files_per_partition,
(SELECT max(c) FROM (SELECT count(DISTINCT f) AS c FROM planned GROUP BY partition_id)) AS max_source_files_per_partition,
count(*) AS copy_op_count, CAST(sum(size) AS DOUBLE) / count(*) AS mean_copy_size, max(size) AS max_copy_size FROM planned"""


@query(f"WITH RECURSIVE {_lpt(_DOC, 4)} {_STATS}")
def lpt_stats(spark, d):
    return partition.stats(partition.plan(doc_tensors(spark, d), 4), 4).drop("model")


@query(f"WITH RECURSIVE {_lpt(_DOC, 4)} SELECT partition_id, max(dest_offset + size) AS max_required_size, count(*) AS n_tensors, CAST(sum(size) AS BIGINT) AS n_bytes, sha256(string_agg(name, ',' ORDER BY name)) AS names_sha256 FROM planned GROUP BY 1")
def partition_plan(spark, d):
    p = partition.plan(doc_tensors(spark, d), 4).withColumn("offset", F.col("dest_offset"))
    s = partition.partition_summary(p).join(p.groupBy("partition_id").agg(F.sum("size").alias("n_bytes")), "partition_id")
    return s.select("partition_id", "max_required_size", F.size("tensor_names").cast("long").alias("n_tensors"), "n_bytes", F.sha2(F.array_join("tensor_names", ","), 256).alias("names_sha256"))


@query(f"SELECT count(*) AS checked, CAST(0 AS BIGINT) AS gaps FROM {_DOC}")
def copy_ops_tiling(spark, d):
    p = partition.plan(doc_tensors(spark, d), 4)
    return p.agg(F.count("*").alias("checked")).crossJoin(partition.gaps(p).agg(F.count("*").alias("gaps")))


@query(f"SELECT CAST(f AS INTEGER) AS source_file_index, CAST(sum(size) AS BIGINT) AS copied, count(*) AS ops FROM {_DOC} GROUP BY 1")
def copy_ops_by_source(spark, d):
    ops_ = partition.copy_ops(partition.plan(doc_tensors(spark, d), 4).withColumn("offset", F.lit(0).cast("long")))
    return ops_.groupBy("source_file_index").agg(F.sum("size").alias("copied"), F.count("*").alias("ops"))


@query(f"SELECT name, CAST(0 AS BIGINT) AS offset, size, CAST(size AS VARCHAR) AS shape, '1' AS stride, 'u8' AS dtype, f AS partition_id, CAST(NULL AS VARCHAR) AS problem FROM {_DOC}")
def index_json_roundtrip(spark, d):
    t = doc_tensors(spark, d).withColumn("offset", F.lit(0).cast("long"))
    entry = indexed.encode_entry(F.col("offset"), F.col("size"), F.col("shape"), F.col("stride"), F.col("dtype"), F.col("file_index"))
    # One document per hundred tensors or so: a document is one cell, so its size is bounded.
    docs = t.groupBy((F.xxhash64("name") % F.lit(64)).alias("g"), (F.col("size") % 16).alias("h")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("name"), F.lit('":'), entry)), ","), F.lit("}")).alias("value"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return indexed.decode_index(docs).select("name", "offset", "size", text("shape"), text("stride"), "dtype", "partition_id", F.col("problem").cast("string"))


@query("WITH m AS (SELECT DISTINCT 'm' || (doc_id % 3) AS manifest, source AS file FROM documents WHERE doc_id % 3 <> 1 OR source <> 'src3'), f AS (SELECT DISTINCT source AS file FROM documents WHERE source <> 'src5'), c AS (SELECT DISTINCT manifest, f.file FROM m, f) SELECT 'manifest_mismatch' AS kind, coalesce(m.manifest, c.manifest) AS name, CASE WHEN m.file IS NULL THEN 'unlisted: ' || c.file ELSE 'not found: ' || m.file END AS detail FROM m FULL JOIN c ON m.manifest = c.manifest AND m.file = c.file WHERE m.file IS NULL OR c.file IS NULL")
def manifest_mismatch(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    pairs = docs.where("doc_id % 3 <> 1 or source <> 'src3'").select(F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("manifest"), "source").distinct()
    text = F.concat(F.lit('{"weight_map":{'), F.array_join(F.collect_list(F.concat(F.lit('"t.'), F.col("source"), F.lit('":"'), F.col("source"), F.lit('"'))), ","), F.lit("}}"))
    return validate.manifest_mismatches(pairs.groupBy("manifest").agg(text.alias("text")), docs.where("source <> 'src5'").select(F.col("source").alias("name")).distinct())


@query(f"WITH RECURSIVE {_lpt(_DOC, 4)}, present AS (SELECT partition_id, sum(size) - CASE WHEN partition_id = 2 THEN 1000 ELSE 0 END AS length FROM planned WHERE partition_id <> 3 GROUP BY 1) SELECT name, planned.partition_id, coalesce(dest_offset + size <= length, false) AS readable FROM planned LEFT JOIN present USING (partition_id)")
def tensor_lookup_join(spark, d):
    p = partition.plan(doc_tensors(spark, d), 4).withColumn("offset", F.col("dest_offset")).drop("path")
    cut = F.when(F.col("partition_id") == 2, 1000).otherwise(0)
    files = p.where("partition_id <> 3").groupBy("partition_id").agg((F.sum("size")).alias("n")).select("partition_id", F.lit("x").alias("path"), (F.col("n") - cut).alias("length"))
    return indexed.located(p, files).select("name", "partition_id", "readable")


@query("SELECT kind, name, detail FROM (SELECT 'duplicate_name' AS kind, 'doc.' || doc_id AS name, '2' AS detail FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'unknown_dtype', 'doc.' || doc_id, 'q4' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'unknown_dtype', 'doc.' || doc_id, 'q4' FROM documents WHERE doc_id % 70 = 0 UNION ALL SELECT 'rank_mismatch', 'doc.' || doc_id, '1 2' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'rank_mismatch', 'doc.' || doc_id, '1 2' FROM documents WHERE doc_id % 110 = 0 UNION ALL SELECT 'partition_out_of_bounds', 'doc.' || doc_id, '9' FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'partition_out_of_bounds', 'doc.' || doc_id, '9' FROM documents WHERE doc_id % 130 = 0)")
def violations(spark, d):
    t = doc_tensors(spark, d).withColumn("id", F.substring("name", 5, 20).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    t = t.unionByName(t.where("id % 10 = 0")).withColumn("dtype", F.when(F.col("id") % 7 == 0, "q4").otherwise(F.col("dtype")))
    t = t.withColumn("stride", F.when(F.col("id") % 11 == 0, F.array(F.lit(1).cast("long"), F.lit(1).cast("long"))).otherwise(F.col("stride"))).withColumn("partition_id", F.when(F.col("id") % 13 == 0, 9).otherwise(0))
    return validate.violations(t, 4)


@query("SELECT m AS model, f AS format, b AS backend, CAST(r AS INTEGER) AS rep FROM (SELECT n_name AS m FROM nation), (SELECT r_name AS f FROM region), (SELECT unnest(['sync', 'async', 'default']) AS b), (SELECT unnest(range(1, 4)) AS r)")
def matrix_product(spark, d):
    backends = spark.createDataFrame([(b,) for b in measure.BACKENDS], "backend string")
    return measure.runs(measure.matrix(_t(spark, d, "nation").select(F.col("n_name").alias("model")), _t(spark, d, "region").select(F.col("r_name").alias("format")), backends, 3)).drop("reps")


@query("SELECT CAST(12 + 36 + 6 + 6 AS BIGINT) AS total_cells, CAST(12 + 180 + 30 + 30 AS BIGINT) AS total_runs")
def experiment_totals(spark, d):
    cells = None
    for name in measure.EXPERIMENTS:
        c = measure.experiment(spark, name)
        cells = c if cells is None else cells.unionByName(c)
    return measure.totals(cells)


@query("SELECT event_id, CAST(r + 10 AS INTEGER) AS rep, CAST(user_id AS BIGINT) AS tensors, event_id * 7 AS bytes, CAST(floor(value) AS DOUBLE) + CAST(r AS DOUBLE) / 4 AS time_ms FROM events, (SELECT unnest([1, 2, 3]) AS r)")
def log_parse(spark, d):
    line = lambda r: F.concat(F.lit(f"iteration {r}: "), F.col("user_id").cast("string"), F.lit(" tensors, "), (F.col("event_id") * 7).cast("string"), F.lit(" bytes, "), F.floor("value").cast("string"), F.lit({1: ".25", 2: ".5", 3: ".75"}[r] + "ms"))
    return measure.parse_log(_t(spark, d, "events").select("event_id", F.concat_ws("\n", F.lit("start"), line(1), line(2), line(3), F.lit("done")).alias("text")), rep_offset=10)


@query(f"SELECT model, format, backend, count(*) AS n, min(time_ms) AS min_ms, median(time_ms) AS median_ms, max(time_ms) AS max_ms FROM {_EV} WHERE error IS NULL GROUP BY ALL")
def cell_stats(spark, d):
    return measure.cell_stats(measurements(spark, d))


_CELLS = f"(SELECT model, format, backend, min(time_ms) AS lo, median(time_ms) AS med, max(time_ms) AS hi FROM {_EV} WHERE error IS NULL GROUP BY ALL)"


@query(f"SELECT model, format, backend AS backend_a, b AS backend_b, CASE WHEN lo <= bh AND bl <= hi THEN 'OVERLAP' ELSE 'SEPARABLE' END AS verdict FROM (SELECT *, lead(backend) OVER w AS b, lead(lo) OVER w AS bl, lead(hi) OVER w AS bh FROM {_CELLS} WINDOW w AS (PARTITION BY model, format ORDER BY med, backend)) WHERE b IS NOT NULL")
def separability(spark, d):
    return measure.separability(measure.cell_stats(measurements(spark, d)))


@query(f"SELECT model, format, backend, median_ms FROM (SELECT *, row_number() OVER (PARTITION BY model, format ORDER BY median_ms, backend) AS r FROM (SELECT model, format, backend, median(time_ms) AS median_ms FROM {_EV} WHERE error IS NULL GROUP BY ALL)) WHERE r = 1")
def best_backend(spark, d):
    return measure.best_backend(measure.cell_stats(measurements(spark, d)))


@query(f"SELECT model, count(*) AS total, count(*) FILTER (error IS NULL) AS successes, avg(CAST(error IS NULL AS DOUBLE)) AS success_rate FROM {_EV} GROUP BY 1")
def success_rate(spark, d):
    return measure.success_rate(measurements(spark, d), "model")


def _lines(spark, d):
    m = measurements(spark, d).withColumns({"rep": F.lit(1), "tensors": F.col("event_id"), "bytes": F.col("event_id") * 10})
    return m.select("event_id", measure.tsv_row().alias("value"))


@query(f"SELECT event_id, model || chr(9) || format || chr(9) || backend || chr(9) || CASE WHEN error IS NULL THEN printf('%.2f', time_ms) || chr(9) || event_id || chr(9) || (event_id * 10) ELSE 'ERROR' || chr(9) || '0' || chr(9) || '0' || chr(9) || error END AS value FROM {_EV}")
def tsv_lines(spark, d):
    return _lines(spark, d)


@query(f"SELECT model, format, backend, 1 AS reps FROM {_EV} WHERE error IS NOT NULL")
def retry_cells(spark, d):
    return measure.retry_cells(_lines(spark, d))


@query(f"SELECT model, format, backend, time_ms FROM {_EV} WHERE backend IN ('sync', 'default')")
def available_backends(spark, d):
    return measure.available(measurements(spark, d), spark.createDataFrame([("sync",), ("io_uring",)], "backend string")).select("model", "format", "backend", "time_ms")


@query("SELECT doc_id, CASE WHEN n = 0 THEN CAST(0 AS BIGINT) ELSE CAST((list_sum(list_transform(range(0, n, 4096), lambda i: CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT))) + CAST('0x' || right(h, 2) AS BIGINT)) % 256 AS BIGINT) END AS checksum FROM (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents)")
def page_touch_checksum(spark, d):
    return _t(spark, d, "documents").select("doc_id", scalars.page_touch(F.coalesce("text", F.lit("")).cast("binary")).alias("checksum"))


@query(f"SELECT name, size, side FROM (SELECT name, size, 'left' AS side FROM {_DOC} WHERE f = 3 UNION ALL SELECT name, size + 1, 'right' FROM {_DOC} WHERE f = 3)")
def backend_parity(spark, d):
    t = doc_tensors(spark, d).select("name", "size", "file_index")
    other = t.withColumn("size", F.when(F.col("file_index") == 3, F.col("size") + 1).otherwise(F.col("size")))
    return ops.symmetric_difference(t.drop("file_index"), other.drop("file_index"))


@query("SELECT event_type AS kind, avg(value) AS avg, min(value) AS min, max(value) AS max FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY 1")
def decode_stats(spark, d):
    return measure.decode_stats(_t(spark, d, "events").select(F.col("event_type").alias("kind"), F.floor("value").cast("double").alias("value")), "kind")


#: Documents lie in so many shards, by their id.
_SHARDS = 8
_FILES = f"(SELECT 'doc.' || doc_id AS name, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, CAST(doc_id % {_SHARDS} AS INTEGER) AS f, sha256(coalesce(text, '')) AS sha FROM documents)"


def shards(spark: SparkSession, d: str) -> str:
    """A folder of real flat shards: a byte tensor for each document, written by the sink."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    file = F.concat(F.lit("shard-"), (F.col("doc_id") % _SHARDS).cast("string"), F.lit(flat.SUFFIX))
    out = shared_dir(spark, "flat")
    docs = _t(spark, d, "documents").select(file.alias("file"), F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name"), F.lit("U8").alias("file_dtype"), F.array(F.octet_length(data).cast("long")).alias("shape"), data.alias("data"))
    sinks.write_flat(docs, out).collect()  # a row a file
    return out


def _sha(chunks: DataFrame) -> DataFrame:
    """name, sha256 of the bytes that chunks of it make."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", F.hex("data").alias("hex"))))
    return chunks.groupBy("name").agg(F.sha2(F.unhex(F.array_join(F.transform(parts, lambda x: x["hex"]), "")), 256).alias("sha256"))


@query(f"SELECT name, 'shard-' || f || '.safetensors' AS file, f AS file_index, 'u8' AS dtype, CAST(size AS VARCHAR) AS shape, '1' AS stride, size, sha AS sha256 FROM {_FILES}")
def flat_roundtrip(spark, d):
    """Shards are written, listed, their headers read, and all bytes read by range in many chunks."""
    rows = flat.catalog(spark, shards(spark, d))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.join(_sha(flat.read_bytes(rows, 4096)), "name").select("name", F.element_at(F.split("path", "/"), -1).alias("file"), "file_index", "dtype", text("shape"), text("stride"), "size", "sha256")


@query(f"WITH RECURSIVE {_lpt(_FILES, 5)} SELECT planned.name, planned.size, dest_offset AS \"offset\", partition_id, 'u8' AS dtype, true AS readable, sha AS sha256 FROM planned JOIN {_FILES} x ON x.name = planned.name")
def convert_roundtrip(spark, d):
    """Real shards are converted, most tensors in several chunks; the index and all bytes are read again."""
    source, out = shards(spark, d), shared_dir(spark, "indexed")
    convert.Converter(5, chunk_bytes=1000).convert(spark, source, out).collect()
    rows = indexed.located(indexed.read_index(spark, out), indexed.partition_files(spark, out))
    return rows.join(_sha(indexed.read_bytes(spark, out, chunk_bytes=700)), "name").select("name", "size", "offset", "partition_id", "dtype", "readable", "sha256")


@query(f"SELECT f AS file_index, count(*) AS n_tensors, CAST(sum(size) AS BIGINT) AS n_bytes FROM {_FILES} GROUP BY 1")
def shard_reader(spark, d):
    """The catalogue through the data source by name."""
    spark.dataSource.register(flat.FlatShards)
    return spark.read.format("flat_shards").load(shards(spark, d)).groupBy("file_index").agg(F.count("*").alias("n_tensors"), F.sum("size").alias("n_bytes"))


@query("SELECT CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS n_bytes FROM documents")
def touched_bytes(spark, d):
    """What a full read of real shards delivers."""
    return ops.touched(flat.read_bytes(flat.catalog(spark, shards(spark, d)), 3000))


@query(f"WITH RECURSIVE {_lpt(_FILES, 3)} SELECT partition_id, count(*) AS n_tensors, CAST(sum(size) AS BIGINT) AS n_bytes, CAST(sum(size) AS BIGINT) AS file_bytes FROM planned GROUP BY 1")
def index_reader(spark, d):
    """A converted folder's index through the data source by name, beside the lengths of its files."""
    out = convert.ensure_converted(spark, shards(spark, d), shared_dir(spark, "indexed"), 3)
    spark.dataSource.register(indexed.TensorIndex)
    rows = spark.read.format("tensor_index").load(out).groupBy("partition_id").agg(F.count("*").alias("n_tensors"), F.sum("size").alias("n_bytes"))
    return rows.join(indexed.partition_files(spark, out).select("partition_id", F.col("length").alias("file_bytes")), "partition_id")


@query("SELECT n_name AS name, layout, CAST(strlen(n_name) AS BIGINT) AS n, md5(n_name) AS md5, ord AS place FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS ord FROM nation), (SELECT unnest(['flat', 'indexed', 'saved']) AS layout)")
def eager_load(spark, d):
    """A small model, of a tensor for each nation, loaded whole from flat shards, from an index folder, and from a shard saved in memory."""
    names = [r["n_name"] for r in _t(spark, d, "nation").select("n_name").collect()]  # 25 rows
    own = {n: ([len(n.encode())], "uint8", n.encode()) for n in names}
    folder, out, saved = shared_dir(spark, "flat"), shared_dir(spark, "indexed"), shared_dir(spark, "saved")
    rows = spark.createDataFrame([(f"{len(n) % 3}.safetensors", n, "U8", s, b) for n, (s, _, b) in own.items()], "file string, name string, file_dtype string, shape array<long>, data binary")
    sinks.write_flat(rows, folder).collect()
    convert.Converter(2).convert(spark, folder, out)
    model.save_flat(own, f"{saved}/one.safetensors", {"made": "by save"})
    got = {"flat": model.load_flat(spark, folder), "indexed": model.load_indexed(spark, out), "saved": model.open_flat(spark, saved).load()}
    out = [(name, layout, len(v), hashlib.md5(v.tobytes()).hexdigest(), i) for layout, tensors in got.items() for i, (name, v) in enumerate(tensors.items())]
    return spark.createDataFrame(out, "name string, layout string, n long, md5 string, place long")


@query("SELECT 'emb.' || vec_id AS name, CAST(len(embedding) AS BIGINT) AS n, CAST(list_min(embedding) AS DOUBLE) AS least, CAST(list_max(embedding) AS DOUBLE) AS most, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def tensor_values(spark, d):
    """Float tensors to bytes, to shards, and back to values, where they lie."""

    def to_bytes(batches):
        for b in batches:
            cells = [np.asarray(x, "<f4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[len(c) // 4] for c in cells], pa.list_(pa.int64())), pa.array(cells, pa.binary())], names=["name", "shape", "data"])

    def to_values(batches):
        for b in batches:
            got = [dtypes.decode(x, kind, shape) for x, kind, shape in zip(b.column(3).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in got], pa.int64()), *(pa.array([float(f(v)) for v in got]) for f in (np.min, np.max, lambda v: v[0]))], names=["name", "n", "least", "most", "first"])

    e = _t(spark, d, "embeddings").select(F.concat(F.lit("emb."), F.col("vec_id").cast("string")).alias("name"), "embedding").mapInArrow(to_bytes, "name string, shape array<long>, data binary")
    folder = shared_dir(spark, "flat")
    sinks.write_flat(e.select(F.concat(F.lit("e"), (F.xxhash64("name") % 4).cast("string"), F.lit(flat.SUFFIX)).alias("file"), "name", F.lit("F32").alias("file_dtype"), "shape", "data"), folder).collect()
    rows = flat.catalog(spark, folder)
    whole = flat.read_bytes(rows).join(rows.select("name", "dtype", "shape"), "name")  # a vector is one chunk
    return whole.select("name", "dtype", "shape", "data").mapInArrow(to_values, "name string, n long, least double, most double, first double")


_NAMES = ("F32", "BF16", "F8_E4M3", "C64", "I64", "bool")


@query("SELECT p_partkey AS part, ['F32','BF16','F8_E4M3','C64','I64','bool'][p_partkey % 6 + 1] AS spelling, ['float32','bfloat16','float8_e4m3fn','complex64','int64','bool'][p_partkey % 6 + 1] AS framework, ['f32','bf16','unknown','unknown','i64','unknown'][p_partkey % 6 + 1] AS canonical, ['F32','BF16',NULL,'C64','I64','BOOL'][p_partkey % 6 + 1] AS saved FROM part")
def dtype_spellings(spark, d):
    def saved(x):
        try:
            return dtypes.saved_spelling(x)
        except ValueError:
            return None

    known = spark.createDataFrame([(i, x, dtypes.framework_name(x), dtypes.from_file(x), saved(x)) for i, x in enumerate(_NAMES)], "k long, spelling string, framework string, canonical string, saved string")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % len(_NAMES)).alias("k")).join(F.broadcast(known), "k").drop("k")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS tensors, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 7 END AS bytes, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) + 0.25 END AS time_ms, CASE WHEN event_id % 4 = 0 THEN 'no disk at all' END AS error FROM events")
def first_iteration(spark, d):
    line = F.concat(F.lit("iteration 1: "), F.col("user_id").cast("string"), F.lit(" tensors, "), (F.col("event_id") * 7).cast("string"), F.lit(" bytes, "), F.floor("value").cast("string"), F.lit(".25ms"))
    return measure.first_iteration(_t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit("no disk\nat all")).otherwise(F.concat_ws("\n", F.lit("start"), line, F.lit("iteration 2: 1 tensors, 1 bytes, 1.5ms"))).alias("text")))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The plan's summary by partition."""
    return partition_plan(spark, d)
