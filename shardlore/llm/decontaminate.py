"""Benchmark decontamination with DataFrame operations alone.

The windows of the benchmark (13 consecutive words of an item, or the whole of a shorter item) are hashed by sub-windows into a
set that is broadcast, if its size is within `broadcast_limit`, else joined by a shuffle. A document is looked at on a grid:
a window of m words at any place holds a whole sub-window of m - s + 1 words that starts at a multiple of s, with s = (m + 1) // 2,
so one place in s is probed and no window is lost. A probe that hits carries the words around it; its windows are then compared
as text. One scan of the documents, and only hits and one row per document are shuffled.

Words are runs of a-z (A-Z lowered), 0-9 and all characters beyond ASCII. A null or empty text has no words. One row comes out
per input row, also for repeated rows and null ids; an item without an id goes by the name "null"; an empty benchmark hits nothing,
and an empty table gives no rows. A very long text is one row's work."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, settle, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, GAP), "")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grid(m: int) -> tuple[int, int]:
    step = (m + 1) // 2
    return step, m - step + 1


def _steps(n: Column, first: int, last: Column, step: int = 1) -> Column:
    return F.when(n >= first, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def benchmark_windows(benchmark: DataFrame, size: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """m, words (array), items (sorted ids, as strings) of each distinct window."""
    b = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    b = b.withColumn("m", F.least(F.size("w"), F.lit(size))).select("item", "w", "m", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("i"))
    b = b.select("item", "m", F.array_join(F.expr("slice(w, i + 1, m)"), " ").alias("win"))
    return b.groupBy("m", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, broadcast_limit: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged [start, end) of hit words)."""
    windows = settle(benchmark_windows(benchmark, size))
    lengths = {r["m"]: r["n"] for r in windows.groupBy("m").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    small = sum(lengths.values()) * size <= broadcast_limit
    held = F.broadcast if small else lambda df: df

    d = id_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def probes(ws: Column, m: int) -> Column:
        step, sub = _grid(m)
        at = lambda p: F.greatest(p - (step - 1), F.lit(0))
        return F.transform(
            _steps(F.size(ws), m, F.size(ws) - sub, step),
            lambda p: F.struct(F.lit(None).cast("long").alias("n"), F.lit(m).alias("m"), at(p).alias("at"), F.xxhash64(F.slice(ws, p + 1, sub)).alias("h"), F.slice(ws, at(p) + 1, p + m - at(p)).alias("near")),
        )

    def rows(ws: Column) -> Column:
        own = F.array(F.struct(F.size(ws).cast("long").alias("n"), F.lit(0).alias("m"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h"), F.expr("cast(null as array<string>)").alias("near")))
        return F.concat(own, *(probes(ws, m) for m in sorted(lengths)))

    p = d.select("row", "doc_id", F.inline(bound(words(F.col("text")), rows)))
    subs = None
    for m in sorted(lengths):
        step, sub = _grid(m)
        s = windows.where(F.col("m") == m).select("m", F.split("win", " ").alias("w")).select("m", "w", F.explode(F.sequence(F.lit(0), F.lit(m - sub))).alias("i"))
        s = s.select("m", F.xxhash64(F.slice("w", F.col("i") + 1, F.lit(sub))).alias("h")).distinct()
        subs = s if subs is None else subs.unionByName(s)
    if subs is not None:
        p = p.join(held(subs.withColumn("found", F.lit(True))), ["m", "h"], "left").where(F.col("found") | F.col("n").isNotNull())
        each = F.transform(
            F.when(F.size("near") >= F.col("m"), F.sequence(F.lit(0), F.size("near") - F.col("m"))),
            lambda k: F.struct((F.col("at") + k).alias("i"), F.array_join(F.slice("near", k + 1, F.col("m")), " ").alias("win")),
        )
        p = p.select("row", "doc_id", "n", "m", F.inline_outer(each)).join(held(windows), ["m", "win"], "left").where(F.col("items").isNotNull() | F.col("n").isNotNull())
    else:
        p = p.select("row", "doc_id", "n", "m", F.lit(0).alias("i"), F.expr("cast(null as array<string>)").alias("items"))
    g = p.groupBy("row", "doc_id").agg(
        F.max("n").alias("n_words"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct(F.col("i").alias("a"), (F.col("i") + F.col("m")).alias("b")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["a"], x["b"] - 1)))))
    g = g.withColumn("places", places).withColumn("n_hit", F.size("places").cast("long"))
    # A span opens and closes where the neighbouring place is none.
    edge = lambda by: F.filter("places", lambda x, i: F.coalesce(F.get("places", i + by) != x + by, F.lit(True)))
    spans = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))
    return g.select(
        "doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), spans.alias("spans"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
