"""Runs experiments over checkpoints at hand: times whole reads, cell by cell, and reports.

    python -m shardlore.experiments --experiment NAME --root FOLDER [--reps N] [--output-dir FOLDER] [--retry-tsv FILE]

The root holds a folder a model, by its slug, with flat shards or an index. Cells run one after another, as measurements must;
each one's reads are spread over the executors. Backends name who schedules reads elsewhere; here it is Spark for all of them."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import catalog as ops
from .operators import measure
from .operators.report import Report
from .sources import flat
from .sources.files import exists


def capabilities(spark: SparkSession) -> DataFrame:
    """backend, available."""
    return spark.createDataFrame([(b, b in model.BACKENDS) for b in (*measure.BACKENDS, "io_uring", "hf-native")], "backend string, available boolean")


def located(spark: SparkSession, directory: str, fmt: str) -> DataFrame:
    """The tensors of a checkpoint with their ranges. fmt: one of measure.FORMATS."""
    if fmt not in measure.FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    return (model.open_flat if fmt == measure.FORMATS[0] else model.open_indexed)(spark, directory).located


def run_cell(spark: SparkSession, directory: str, name: str, fmt: str, backend: str, iterations: int = 1, rep_offset: int = 0) -> list[tuple]:
    """A result an iteration, or one error: what measure.RESULT names."""
    out = []
    try:
        if not capabilities(spark).where((F.col("backend") == backend) & F.col("available")).count():
            raise ValueError(f"unsupported backend: {backend}")
        for i in range(iterations):
            began = time.perf_counter()
            rows = located(spark, directory, fmt)
            n = rows.count()
            size = ops.touched(flat.read_bytes(rows)).first()["n_bytes"]
            out.append((name, fmt, backend, rep_offset + i + 1, (time.perf_counter() - began) * 1000, n, size, None))
    except Exception as e:  # a cell that fails is a result
        return [(name, fmt, backend, rep_offset + 1, None, 0, 0, (" ".join(str(e).split()) or type(e).__name__)[:500])]
    return out


def run(spark: SparkSession, cells: DataFrame, root: str, name: str) -> Report:
    """Every cell's runs. A model that lies elsewhere than under root is an error of its cells."""
    report = Report(spark, name)
    for c in cells.toLocalIterator():  # stated lists, some dozens
        folder = f"{root.rstrip('/')}/{c['model'].replace('/', '-').lower()}"
        report.extend(run_cell(spark, folder, c["model"], c["format"], c["backend"], c["reps"]))
    return report


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shardlore.experiments")
    p.add_argument("--experiment", choices=list(measure.EXPERIMENTS), default="held-out-validation")
    p.add_argument("--root", required=True)
    p.add_argument("--reps", type=int, default=0)
    p.add_argument("--output-dir", default="results")
    p.add_argument("--retry-tsv", default="")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("experiments").getOrCreate()
    if a.retry_tsv:
        if not exists(spark, a.retry_tsv):
            print(f"there is no {a.retry_tsv}", file=sys.stderr)
            return 1
        name, cells = "retry", measure.retry_cells(spark.read.text(a.retry_tsv))
    else:
        name, cells = a.experiment, measure.experiment(spark, a.experiment, a.reps)
    t = measure.totals(cells).first()
    print(f"{name}: {t['total_cells']} cells, {t['total_runs']} runs")
    report = run(spark, cells, a.root, name)
    print(report.summary())
    anchor = t["total_runs"] > t["total_cells"]
    report.write_tsv(f"{a.output_dir.rstrip('/')}/{name}", anchor)
    if anchor:
        for r in measure.separability(measure.cell_stats(report.results)).toLocalIterator():
            print(f"{r['model']} {r['format']}: {r['backend_a']} and {r['backend_b']} {r['verdict']}")
    return 0 if report.success_rate() == 1 else 2


__all__ = ["capabilities", "located", "main", "run", "run_cell"]

if __name__ == "__main__":
    sys.exit(main())
