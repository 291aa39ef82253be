"""Rules over catalogues: each gives rows (kind, name, detail); strict mode raises the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ShardloreError
from ..functions.dtypes import SAVED, canonical, width
from ..functions.scalars import elements


class ViolationError(ShardloreError):
    pass


def _rows(df: DataFrame, kind: str, detail) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col("name"), detail.cast("string").alias("detail"))


def empty_names(c: DataFrame) -> DataFrame:
    return _rows(c.where("name is null or name = ''"), "empty_name", F.lit(""))


def unknown_dtypes(c: DataFrame) -> DataFrame:
    return _rows(c.where(canonical(F.col("dtype")).isNull()), "unknown_dtype", F.coalesce("dtype", F.lit("")))


def rank_mismatches(c: DataFrame) -> DataFrame:
    return _rows(c.where(F.col("stride").isNotNull() & (F.size("shape") != F.size("stride"))), "rank_mismatch", F.concat_ws(" ", F.size("shape").cast("string"), F.size("stride").cast("string")))


def overflows(c: DataFrame) -> DataFrame:
    return _rows(c.where(F.try_add("offset", "size").isNull()), "offset_overflow", F.concat_ws(" ", F.col("offset").cast("string"), F.col("size").cast("string")))


def duplicate_names(c: DataFrame) -> DataFrame:
    return _rows(c.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_name", F.col("n"))


def size_mismatches(c: DataFrame) -> DataFrame:
    """A warning only: readers of both layouts accept sizes that differ from shape times width."""
    want = elements(F.col("shape")) * width(F.col("dtype"))
    return _rows(c.withColumn("want", want).where("want <> size"), "size_mismatch", F.concat_ws(" ", F.col("size").cast("string"), F.col("want").cast("string")))


def partitions_out_of_bounds(c: DataFrame, n: int) -> DataFrame:
    return _rows(c.where(~F.col("partition_id").between(0, n - 1)), "partition_out_of_bounds", F.col("partition_id"))


def unreadable(located: DataFrame) -> DataFrame:
    """Index rows without bytes: a missing or short partition."""
    return _rows(located.where("not readable"), "no_bytes", F.col("partition_id"))


def tensors_not_found(c: DataFrame, asked: DataFrame) -> DataFrame:
    """Names that are asked for and not listed."""
    return _rows(asked.select("name").join(c.select("name"), "name", "left_anti"), "tensor_not_found", F.lit(""))


def partitions_not_found(index: DataFrame, files: DataFrame) -> DataFrame:
    """Partitions that an index names and that have no file; empty tensors need none."""
    gone = index.where("size > 0").select("partition_id").distinct().join(files.select("partition_id"), "partition_id", "left_anti")
    return gone.select(F.lit("partition_not_found").alias("kind"), F.col("partition_id").cast("string").alias("name"), F.lit("").alias("detail"))


def partitions_too_small(index: DataFrame, files: DataFrame) -> DataFrame:
    """Partition files that end before the last of their tensors: the bytes there, and those needed."""
    need = index.groupBy("partition_id").agg(F.max(F.try_add("offset", "size")).alias("need"))
    short = need.join(files.select("partition_id", "length"), "partition_id").where("length < need")
    return short.select(F.lit("partition_too_small").alias("kind"), F.col("partition_id").cast("string").alias("name"), F.concat_ws(" ", F.col("length").cast("string"), F.col("need").cast("string")).alias("detail"))


def sizes_too_large(c: DataFrame, most: int = (1 << 31) - 1) -> DataFrame:
    """Tensors that one cell of a row can't hold; they are read in chunks."""
    return _rows(c.where(F.col("size") > most), "size_too_large", F.col("size"))


def invalid_entries(decoded: DataFrame) -> DataFrame:
    """Entries of index documents that break a rule, as decode_index tells them."""
    return _rows(decoded.where("problem is not null"), "invalid_index_format", F.col("problem"))


def unparsed(texts: DataFrame, name: str, text: str) -> DataFrame:
    """Documents that are no JSON object."""
    return texts.where(F.from_json(text, "map<string,variant>").isNull()).select(F.lit("json_parse_error").alias("kind"), F.col(name).alias("name"), F.substring(text, 1, 80).alias("detail"))


def invalid_metadata(c: DataFrame) -> DataFrame:
    """Negative numbers, and ranges that leave their file where its length is known."""
    negative = (F.col("offset") < 0) | (F.col("size") < 0) | F.exists("shape", lambda x: x < 0)
    beyond = F.try_add("offset", "size") > F.col("file_bytes") if "file_bytes" in c.columns else F.lit(False)
    return _rows(c.where(negative | beyond), "invalid_metadata", F.concat_ws(" ", F.col("offset").cast("string"), F.col("size").cast("string")))


def invalid_paths(c: DataFrame) -> DataFrame:
    """Names of files that would leave their folder, or name none."""
    return c.where(F.col("file").isNull() | (F.col("file") == "") | F.contains("file", F.lit("/")) | F.col("file").isin(".", "..")).select(F.lit("path").alias("kind"), F.col("file").alias("name"), F.lit("").alias("detail"))


def invalid_input(tensors: DataFrame) -> DataFrame:
    """What a writer refuses: unnamed tensors, types that can't be saved, and bytes that are not there."""
    wrong = F.when(F.coalesce("name", F.lit("")) == "", "no name").when(~F.col("file_dtype").isin(*sorted(SAVED)), F.concat(F.lit("dtype "), "file_dtype")).when(F.col("data").isNull(), "no bytes")
    return _rows(tensors.withColumn("wrong", wrong).where("wrong is not null"), "invalid_input", F.col("wrong"))


def manifest_mismatches(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """manifests (manifest, text): each one's weight_map must name exactly the files found. Values that aren't strings don't count; a manifest without a weight_map object is a violation."""
    m = manifests.select("manifest", F.get_json_object("text", "$.weight_map").alias("w"))
    broken = m.where(F.col("w").isNull() | ~F.startswith("w", F.lit("{")) | F.from_json("w", "map<string,variant>").isNull()).select(F.lit("manifest_broken").alias("kind"), F.col("manifest").alias("name"), F.lit("no weight_map").alias("detail"))
    value = F.explode(F.map_values(F.from_json("w", "map<string,variant>")))
    named = m.select("manifest", value.alias("v")).where("schema_of_variant(v) = 'STRING'").select("manifest", F.expr("variant_get(v, '$', 'string')").alias("file")).distinct()
    found = m.where(F.startswith("w", F.lit("{"))).select("manifest").distinct().crossJoin(files.select(F.col("name").alias("file")).distinct())
    both = named.withColumn("named", F.lit(True)).join(found.withColumn("found", F.lit(True)), ["manifest", "file"], "full")
    wrong = both.where("named is null or found is null").select(F.lit("manifest_mismatch").alias("kind"), F.col("manifest").alias("name"), F.concat(F.when(F.col("named").isNull(), "unlisted: ").otherwise("not found: "), "file").alias("detail"))
    return broken.unionByName(wrong)


def violations(c: DataFrame, partitions: int | None = None) -> DataFrame:
    rules = [empty_names(c), unknown_dtypes(c), overflows(c), duplicate_names(c)]
    if "stride" in c.columns:
        rules.append(rank_mismatches(c))
    if partitions is not None:
        rules.append(partitions_out_of_bounds(c, partitions))
    return reduce(DataFrame.unionByName, rules)


def enforce(found: DataFrame) -> None:
    first = found.limit(1).collect()
    if first:
        raise ViolationError(": ".join(str(x) for x in first[0]))
