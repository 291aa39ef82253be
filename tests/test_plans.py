import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardlore.functions import scalars
from shardlore.operators import measure
from shardlore.plans import partition


def plainly(sizes, files, n):
    b, held, out = [0] * n, [set() for _ in range(n)], []
    for s, f in zip(sizes, files):
        p = min(range(n), key=lambda i: (b[i], f not in held[i], i))
        b[p] += s
        held[p].add(f)
        out.append(p)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=40), st.integers(1, 9))
def test_assign(items, n):
    items.sort(key=lambda x: -x[0])
    sizes, files = [x[0] for x in items], [x[1] for x in items]
    assert partition.assign(sizes, files, n) == plainly(sizes, files, n)


@pytest.mark.parametrize("n", [1, 3, 4, 8, 50])
def test_plan(spark, n):
    r = random.Random(n)
    rows = [(m, f"t{i}", r.choice([0, 8, 8, 16, 64]), r.randrange(4)) for m in ("m", "k") for i in range(30)]
    df = spark.createDataFrame(rows, "model string, name string, size long, file_index int")
    got = partition.plan(df, n).collect()
    fold = {(x.model, x.name): x.partition_id for x in partition.plan_by_fold(df, n).collect()}
    for m in ("m", "k"):
        own = sorted((x for x in rows if x[0] == m), key=lambda x: (-x[2], x[1]))
        want = dict(zip([x[1] for x in own], plainly([x[2] for x in own], [x[3] for x in own], n)))
        assert {x.name: x.partition_id for x in got if x.model == m} == want == {k[1]: v for k, v in fold.items() if k[0] == m}
    assert partition.gaps(partition.plan(df, n)).isEmpty()


def test_balancing(spark):
    df = spark.createDataFrame([("m", "a", 16, 0), ("m", "b", 32, 0), ("m", "c", 64, 0), ("m", "d", 128, 0)], "model string, name string, size long, file_index int")
    assert {r.name: (r.partition_id, r.dest_offset) for r in partition.plan(df, 2).collect()} == {"d": (0, 0), "c": (1, 0), "b": (1, 64), "a": (1, 96)}
    s = partition.stats(partition.plan(df, 5), 5).first()
    assert (s.partition_count, s.mean_partition_bytes, s.max_partition_bytes, s.mean_source_files_per_partition) == (5, 48, 128, 0.8)


@pytest.mark.parametrize("shape,want", [([], []), ([5], [1]), ([2, 3, 4], [12, 4, 1]), ([0, 2], [2, 1])])
def test_stride(spark, shape, want):
    df = spark.createDataFrame([(shape,)], "s array<bigint>")
    assert df.select(scalars.contiguous_stride(F.col("s"))).first()[0] == want


def test_experiments(spark):
    assert {n: tuple(measure.totals(measure.experiment(spark, n)).first()) for n in measure.EXPERIMENTS} == {"held-out-validation": (12, 12), "full-anchor-matrix": (36, 180), "targeted-anchors": (6, 30), "hf-native-baseline": (6, 30)}
    assert measure.totals(measure.experiment(spark, "targeted-anchors", 9)).first()[1] == 30 and measure.totals(measure.experiment(spark, "full-anchor-matrix", 2)).first()[1] == 72
    with pytest.raises(ValueError):
        measure.experiment(spark, "absent")


def test_tsv(spark, tmp_path):
    rows = [("m", "f", "sync", 1, 12.345, 3, 40, None), ("m", "f", "async", 1, 0.0, 0, 0, "exit 3")]
    df = spark.createDataFrame(rows, measure.RESULT)
    measure.write_tsv(df, str(tmp_path / "a"), anchor=True)
    got = {r.backend: r for r in measure.read_tsv(spark, str(tmp_path / "a")).collect()}
    assert (got["sync"].time_ms, got["sync"].tensors, got["sync"].rep, got["sync"].error) in [(12.35, 3, 1, None), (12.34, 3, 1, None)]
    assert got["async"].time_ms is None and got["async"].error == "exit 3"
    (tmp_path / "h.tsv").write_text("format\tmodel\tbackend\trep\tms\ttensors\tbytes\nf\tm\tsync\t1\t\t\t\n")
    r = measure.read_tsv(spark, str(tmp_path / "h.tsv")).first()
    assert (r.model, r.format, r.time_ms, r.bytes) == ("m", "f", None, None)
    lines = spark.read.text(str(tmp_path / "a"))
    assert [tuple(x) for x in measure.retry_cells(lines).collect()] == [("m", "f", "async", 1)]
    assert measure.preview(lines, 2)[1] == 1
    assert measure.success_rate(df).first()["success_rate"] == 0.5


def test_first_iteration(spark):
    df = spark.createDataFrame([("a", "iteration 1: 3 tensors, 40 bytes, 1.50ms\niteration 2: 3 tensors, 40 bytes, 2.50ms"), ("b", "failed\nhere")], "k string, text string")
    got = {r.k: (r.tensors, r.time_ms, r.error) for r in measure.first_iteration(df).collect()}
    assert got == {"a": (3, 1.5, None), "b": (None, None, "failed here")}


def test_separability_of_apart_and_touching_ranges(spark):
    cell = lambda b, *ts: [("m", "f", b, t, None) for t in ts]
    rows = cell("fast", 1.0, 2.0, 3.0) + cell("mid", 3.0, 3.5, 4.0) + cell("slow", 9.0, 9.5) + [("m", "f", "slow", 2.0, "exit 1")] + [("m", "g", "only", 1.0, None)]
    got = measure.separability(measure.cell_stats(spark.createDataFrame(rows, "model string, format string, backend string, time_ms double, error string"))).collect()
    assert [(r.backend_a, r.backend_b, r.verdict) for r in sorted(got, key=lambda r: r.backend_a)] == [("fast", "mid", "OVERLAP"), ("mid", "slow", "SEPARABLE")]


def test_tables_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("model\tformat\tbackend\ttime_ms\ttensors\tbytes\nm\tf\tsync\t1.5\t3\t10\nm\tf\tasync\tERROR\t0\t0\tno disk\nm\tf\tdefault\t\t\t\n")
    (tmp_path / "b.tsv").write_text("format\tmodel\tbackend\trep\tms\ttensors\tbytes\ng\tk\tsync\t2\t7\t1\t0\n")
    rows = {(r.model, r.backend): (r.format, r.rep, r.time_ms, r.tensors, r.bytes, r.error) for r in measure.read_tsv(spark, str(tmp_path / "*.tsv")).collect()}
    assert rows == {("m", "sync"): ("f", None, 1.5, 3, 10, None), ("m", "async"): ("f", None, None, 0, 0, "no disk"), ("m", "default"): ("f", None, None, None, None, None), ("k", "sync"): ("g", 2, 7.0, 1, 0, None)}


def test_experiments_run(spark, tmp_path, capsys):
    import numpy as np

    from shardlore import experiments, model
    from shardlore.operators.report import Report

    (tmp_path / "qwen-qwen3-8b").mkdir()
    model.save_flat({"a": np.arange(10, dtype=np.uint8), "b": np.zeros(3, np.float32)}, str(tmp_path / "qwen-qwen3-8b" / "x.safetensors"))
    good = experiments.run_cell(spark, str(tmp_path / "qwen-qwen3-8b"), "Qwen/Qwen3-8B", "safetensors", "sync", 2, 5)
    assert [r[3] for r in good] == [6, 7] and all(r[5:] == (2, 22, None) and r[4] > 0 for r in good)
    bad = experiments.run_cell(spark, str(tmp_path / "none"), "x", "safetensors", "sync", 3)
    assert len(bad) == 1 and bad[0][3] == 1 and "none" in bad[0][7]
    assert "unsupported backend" in experiments.run_cell(spark, str(tmp_path / "qwen-qwen3-8b"), "x", "safetensors", "hf-native")[0][7]
    report = Report(spark, "r").extend(good).add(bad[0])
    assert (report.successes().count(), report.failures().count()) == (2, 1) and abs(report.success_rate() - 2 / 3) < 1e-9 and report.summary().startswith("r: 2 of 3")
    assert Report(spark, "e").success_rate() == 0
    assert experiments.main(["--experiment", "held-out-validation", "--root", str(tmp_path), "--output-dir", str(tmp_path / "out")]) == 2
    assert "held-out-validation: 3 of 12" in capsys.readouterr().out
    lines = spark.read.text(str(tmp_path / "out" / "held-out-validation"))
    assert lines.count() == 13 and measure.retry_cells(lines).count() == 9


def test_small_functions(spark, monkeypatch):
    assert [r.partition_id for r in scalars.partition_ids(spark, 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        scalars.partition_ids(spark, 0)
    assert [r[0] for r in spark.createDataFrame([(4,), (2**31 - 1,)], "p int").select(scalars.next_partition(F.col("p"))).collect()] == [5, None]
    monkeypatch.setenv("SHARDLORE_CACHE_DIR", "/x")
    assert scalars.cache_root() == "/x"
    monkeypatch.delenv("SHARDLORE_CACHE_DIR")
    monkeypatch.setenv("XDG_CACHE_HOME", "/y")
    assert scalars.cache_root() == "/y/shardlore"


def test_descriptor_and_serving(spark):
    from shardlore import model
    from shardlore.operators import catalog

    files = spark.createDataFrame([("/x/b", "b", 5), ("/x/a", "a", 7)], "path string, name string, length long")
    assert tuple(catalog.descriptor(files).first()) == (["a", "b"], 2, 12) and tuple(catalog.descriptor(files.limit(0)).first()) == ([], 0, 0)
    model.check_serving("safetensors", "io_uring")
    for bad in (("gguf", "sync"), ("safetensors", "async")):
        with pytest.raises(ValueError, match="unsupported"):
            model.check_serving(*bad)
