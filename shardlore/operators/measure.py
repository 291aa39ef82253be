"""Measurements of load times: matrices of cells, logs, tables of results, and their statistics."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITERATION = r"iteration (\d+): (\d+) tensors, (\d+) bytes, ([\d.]+)ms"
RESULT = "model string, format string, backend string, rep int, time_ms double, tensors long, bytes long, error string"
MATRIX = ("model", "format", "backend", "time_ms", "tensors", "bytes")
ANCHOR = ("model", "format", "backend", "rep", "time_ms", "tensors", "bytes")
# The models, formats and backends of the published matrices.
MODELS = ("Qwen/Qwen3-0.6B", "HuggingFaceTB/SmolLM3-3B", "Qwen/Qwen3-4B", "Qwen/Qwen3-8B", "Qwen/Qwen3-14B", "Qwen/Qwen3-32B")
HELD_OUT = ("Qwen/Qwen3-8B", "mistralai/Mistral-7B-Instruct-v0.3")
FORMATS, BACKENDS = ("safetensors", "serverlessllm"), ("sync", "async", "default")
TARGETED = (("Qwen/Qwen3-14B", "safetensors", "sync"), ("Qwen/Qwen3-14B", "safetensors", "default"), ("Qwen/Qwen3-14B", "serverlessllm", "sync"), ("Qwen/Qwen3-14B", "serverlessllm", "default"), ("Qwen/Qwen3-4B", "serverlessllm", "async"), ("Qwen/Qwen3-4B", "serverlessllm", "default"))
#: Each experiment's repetitions and cells: lists to multiply, or the cells themselves.
EXPERIMENTS = {
    "held-out-validation": (1, {"model": HELD_OUT, "format": FORMATS, "backend": BACKENDS}),
    "full-anchor-matrix": (5, {"model": MODELS, "format": FORMATS, "backend": BACKENDS}),
    "targeted-anchors": (5, TARGETED),
    "hf-native-baseline": (5, {"model": MODELS, "format": FORMATS[:1], "backend": ("hf-native",)}),
}


def matrix(models: DataFrame, formats: DataFrame, backends: DataFrame, reps: int = 1) -> DataFrame:
    """The product of three stated lists."""
    return models.crossJoin(formats).crossJoin(backends).withColumn("reps", F.lit(reps))


def runs(cells: DataFrame) -> DataFrame:
    """A row per repetition, from 1."""
    return cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.col("reps"))))


def totals(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("total_cells"), F.coalesce(F.sum("reps"), F.lit(0)).alias("total_runs"))


def experiment(spark: SparkSession, name: str, reps: int = 0) -> DataFrame:
    """Cells of a named experiment. reps over 0 replaces its repetitions, except where its cells are listed one by one."""
    if name not in EXPERIMENTS:
        raise ValueError(f"there is no experiment {name!r}, only {', '.join(EXPERIMENTS)}")
    own, cells = EXPERIMENTS[name]
    listed = not isinstance(cells, dict)
    rows = cells if listed else product(*cells.values())
    return spark.createDataFrame([(*c, reps if reps > 0 and not listed else own) for c in rows], "model string, format string, backend string, reps int")


def available(cells: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Cells whose backend is available; "default" always is."""
    return cells.join(capabilities.select("backend").unionByName(cells.sparkSession.createDataFrame([("default",)], "backend string")).distinct(), "backend", "left_semi")


def parse_log(logs: DataFrame, text: str = "text", rep_offset: Column | int = 0) -> DataFrame:
    """logs' columns with rep, tensors, bytes and time_ms of every iteration that the text reports."""
    offset = rep_offset if isinstance(rep_offset, Column) else F.lit(rep_offset)
    part = lambda k: F.regexp_extract("hit", ITERATION, k)
    found = logs.select("*", F.explode(F.regexp_extract_all(text, F.lit(ITERATION), F.lit(0))).alias("hit"))
    return found.select(*[c for c in logs.columns if c != text], (offset + part(1).cast("int")).alias("rep"), part(2).cast("long").alias("tensors"), part(3).cast("long").alias("bytes"), part(4).cast("double").alias("time_ms"))


def first_iteration(logs: DataFrame, text: str = "text") -> DataFrame:
    """iteration 1 alone, or a row with the text as an error on one line."""
    one = ITERATION.replace(r"(\d+):", "1:", 1)
    hit = F.regexp_extract(text, one, 0)
    part = lambda k: F.when(hit != "", F.regexp_extract(text, one, k))
    return logs.select(*[c for c in logs.columns if c != text], part(1).cast("long").alias("tensors"), part(2).cast("long").alias("bytes"), part(3).cast("double").alias("time_ms"), F.when(hit == "", F.regexp_replace(text, r"\n", " ")).alias("error"))


def tsv_row(anchor: bool = False) -> Column:
    """A result's line; an error's has ERROR, two zeros and the message."""
    head = [F.col("model"), F.col("format"), F.col("backend"), *([F.col("rep").cast("string")] if anchor else [])]
    good = F.concat_ws("\t", *head, F.format_string("%.2f", "time_ms"), F.col("tensors").cast("string"), F.col("bytes").cast("string"))
    return F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.concat_ws("\t", *head, F.lit("ERROR"), F.lit("0"), F.lit("0"), F.col("error"))).otherwise(good)


def write_tsv(results: DataFrame, path: str, anchor: bool = False) -> None:
    """One table of text; measurements are few, and their order is kept by cell and repetition."""
    lines = results.orderBy("model", "format", "backend", "rep").select(tsv_row(anchor).alias("\t".join(ANCHOR if anchor else MATRIX)))
    lines.coalesce(1).write.option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Results of either layout, each file by its own first line; blank cells are null, and ERROR rows have their message in error. Tables of measurements are small, so a file is one row at first."""
    files = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    rows = files.select(F.split(F.get("lines", F.lit(0)), "\t").alias("head"), F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).where("line <> ''").select("head", F.split("line", "\t").alias("cells"))
    cell = lambda c: F.nullif(F.get("cells", F.array_position("head", c).cast("int") - 1), F.lit(""))
    time = F.coalesce(cell("time_ms"), cell("ms"))
    return rows.select(*(cell(c).alias(c) for c in ("model", "format", "backend")), cell("rep").try_cast("int").alias("rep"), time.try_cast("double").alias("time_ms"), cell("tensors").try_cast("long").alias("tensors"), cell("bytes").try_cast("long").alias("bytes"), F.when(time == "ERROR", F.get("cells", F.size("head"))).alias("error"))


def retry_cells(lines: DataFrame) -> DataFrame:
    """Cells of all lines (value) that contain ERROR, to be run once."""
    at = lambda i: F.get(F.split(F.trim("value"), "\t"), F.lit(i))
    return lines.where(F.contains("value", F.lit("ERROR"))).select(at(0).alias("model"), at(1).alias("format"), at(2).alias("backend"), F.lit(1).alias("reps"))


def preview(lines: DataFrame, most: int = 12) -> tuple[list[str], int]:
    """The first lines, and how many rows there are beyond them."""
    return [r[0] for r in lines.limit(most).collect()], max(0, lines.count() - most)


def ok() -> Column:
    return F.col("error").isNull()


def success_rate(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok()).alias("successes"), F.coalesce(F.avg(ok().cast("double")), F.lit(0.0)).alias("success_rate"))


def cell_stats(results: DataFrame) -> DataFrame:
    """n, least, median and most of each cell's successful times; the median is exact."""
    return results.where(ok()).groupBy("model", "format", "backend").agg(F.count("*").alias("n"), F.min("time_ms").alias("min_ms"), F.percentile("time_ms", F.lit(0.5)).alias("median_ms"), F.max("time_ms").alias("max_ms"))


def separability(stats: DataFrame) -> DataFrame:
    """Neighbours by median within a model and format: OVERLAP if their closed ranges meet, else SEPARABLE. Equal medians keep the order of names."""
    w = Window.partitionBy("model", "format").orderBy("median_ms", "backend")
    nxt = F.lead(F.struct("backend", "min_ms", "max_ms")).over(w)
    s = stats.withColumn("b", nxt).where("b is not null")
    return s.select("model", "format", F.col("backend").alias("backend_a"), F.col("b.backend").alias("backend_b"), F.when((F.col("min_ms") <= F.col("b.max_ms")) & (F.col("b.min_ms") <= F.col("max_ms")), "OVERLAP").otherwise("SEPARABLE").alias("verdict"))


def best_backend(stats: DataFrame) -> DataFrame:
    w = Window.partitionBy("model", "format").orderBy("median_ms", "backend")
    return stats.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("model", "format", "backend", "median_ms")


def decode_stats(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
