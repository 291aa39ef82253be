"""Quality rules: statistics of whole texts, and a decision list that is learned from labels.

Statistics are DataFrame expressions over one row each; nothing is shuffled for them. The decision list comes from sequential
covering on at most `train_limit` labelled rows (those with the lowest hash of id and statistics, equal rows once): a rule is a conjunction of thresholds,
grown by information gain on two thirds of the rows and pruned on the rest; rules are taken while they are right often enough
on the rows held for pruning. The list becomes one ordered Spark conditional expression over the statistics' columns.

A null or empty text has no words and fails the base rules. Without labels the list is empty and keeps all that pass the base
rules. Repeated rows and null ids give a row each; a very long text is one row's work; an empty table gives none."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest, settle, table, unsettle
from .decontaminate import bound

GAP = r"[\x20\x09-\x0D]+"
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "calls", "digits", "distinct", "line_words")


def repeated_words(ws: Column, size: int = 3) -> Column:
    """Words inside windows of `size` words that occur twice or more, by 64-bit hashes of windows."""
    none = F.expr("cast(array() as array<bigint>)")
    hashes = F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(size))))).otherwise(none)

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(a: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(a, k)["h"] == F.get(a, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: F.get(a, k)["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, i: F.struct((i + size).alias("end"), (acc["n"] + i + size - F.greatest(acc["end"], i)).cast("long").alias("n"))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(F.aggregate(bound(by_hash, twice), start, add)["n"])

    return bound(hashes, covered)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the base rules, and what the learned list may test."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated_words(ws).alias("n_repeat_words"), F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    of_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), bound(F.array_remove(F.split(t, GAP), ""), of_words).alias("w"), of_lines.alias("l"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit("[A-Z]")).alias("n_capitals"), F.regexp_count(t, F.lit("[!?]")).alias("n_calls"), F.regexp_count(t, F.lit("[0-9]")).alias("n_digits"),
    )
    d = d.select("doc_id", "w.*", "l.*", "n_symbols", "n_capitals", "n_calls", "n_digits")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    shares = {
        "words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "word_chars"), "calls": per("n_calls", "n_words"), "digits": per("n_digits", "word_chars"), "distinct": per("n_distinct", "n_words"), "line_words": per("n_words", "n_lines"),
    }
    return d.withColumns({f"f_{k}": v for k, v in shares.items()}).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


Rule = list[tuple[str, str, float]]
_TEST = {"<=": operator.le, ">": operator.gt}


def _covers(rule: Rule, row: dict) -> bool:
    return all(_TEST[op](row[f], x) for f, op, x in rule)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: list[tuple[dict, int]], longest: int) -> Rule:
    rule: Rule = []
    while len(rule) < longest:
        p0 = sum(y for _, y in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for f in FEATURES:
            order = sorted((r[f], y) for r, y in rows)
            p = n = 0
            for k, (x, y) in enumerate(order[:-1]):
                p, n = p + y, n + 1 - y
                if order[k + 1][0] > x:
                    cut = (x + order[k + 1][0]) / 2
                    for g, test in ((_gain(p, n, p0, n0), (f, "<=", cut)), (_gain(p0 - p, n0 - n, p0, n0), (f, ">", cut))):
                        if g > best:
                            best, found = g, test
        if not found:
            break
        rule.append(found)
        rows = [x for x in rows if _covers([found], x[0])]
    return rule


def _worth(rule: Rule, rows: list[tuple[dict, int]]) -> tuple[float, int]:
    own = [y for r, y in rows if _covers(rule, r)]
    p = sum(own)
    return ((2 * p - len(own)) / len(own) if own else -1.0), p


def learn(rows: list[tuple[dict, int]], longest: int = 3, most_rules: int = 12, precision: float = 0.95, support: int = 3) -> list[Rule]:
    """Rules for label 1, in order. rows: (features, label); every third is held for pruning."""
    grow, prune, out = [x for i, x in enumerate(rows) if i % 3], rows[::3], []
    while len(out) < most_rules and (rule := _grow(grow, longest)):
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, prune)[0])
        worth, p = _worth(rule, prune)
        if (worth + 1) / 2 < precision or p < support:
            break
        out.append(rule)
        grow = [x for x in grow if not _covers(rule, x[0])]
        prune = [x for x in prune if not _covers(rule, x[0])]
    return out


def conditional(rules: list[Rule]) -> Column:
    """True where no rule holds; the number of the first rule that does is its place in the list."""
    out = None
    for rule in rules:
        test = reduce(operator.and_, [(F.col(f"f_{f}") <= x) if op == "<=" else (F.col(f"f_{f}") > x) for f, op, x in rule])
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def training_rows(stats: DataFrame, labels: DataFrame, train_limit: int, label_col: str = "quality") -> list[tuple[dict, int]]:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    own = settle(stats.where(~F.col("base_failed")).join(known, "doc_id").select("y", "doc_id", *(f"f_{f}" for f in FEATURES)))
    rows = sorted(lowest(own, F.xxhash64("doc_id", *(f"f_{f}" for f in FEATURES)), train_limit).collect(), key=lambda r: r["hash"])
    unsettle(own)
    return [({f: r[f"f_{f}"] for f in FEATURES}, 1 - r["y"]) for r in rows]


def quality(docs: DataFrame, labels: DataFrame, train_limit: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics with base_failed and kept."""
    stats = settle(statistics(docs, id_col, text_col))
    rules = learn(training_rows(stats, labels, train_limit))
    return stats.withColumn("kept", ~F.col("base_failed") & conditional(rules))


def op5(spark, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
