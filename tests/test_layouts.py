import json
import struct

import numpy as np
import pytest

from shardlore import convert, model
from shardlore.functions import dtypes
from shardlore.operators import catalog as ops
from shardlore.operators import validate
from shardlore.sources import flat, indexed, sinks


def shard(path, tensors, metadata=None):
    """tensors: name to (dtype, shape, bytes)."""
    head, body = ({"__metadata__": metadata} if metadata else {}), b""
    for name, (dtype, shape, data) in tensors.items():
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    raw = json.dumps(head).encode()
    path.write_bytes(struct.pack("<Q", len(raw)) + raw + body)


@pytest.fixture
def two(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    shard(d / "z_shard.safetensors", {"b": ("F32", [2], bytes(range(5, 13))), "empty": ("F32", [0, 2], b""), "scalar": ("F32", [], np.float32(42).tobytes())}, {"version": "1.0"})
    shard(d / "a_shard.safetensors", {"a": ("U8", [4], bytes([1, 2, 3, 4])), "half": ("BF16", [2], b"\x80\x3f\x00\x40")})
    (d / "sub").mkdir()
    shard(d / "sub" / "other.safetensors", {"x": ("U8", [1], b"x")})
    (d / "note.txt").write_text("no shard")
    return d


def test_catalogue(spark, two):
    rows = {r["name"]: r for r in flat.catalog(spark, str(two)).collect()}
    assert set(rows) == {"a", "b", "half", "empty", "scalar"}
    assert rows["a"]["file_index"] == 0 and rows["b"]["file_index"] == 1
    assert (rows["scalar"]["shape"], rows["scalar"]["stride"], rows["empty"]["size"]) == ([], [], 0)
    assert rows["half"]["dtype"] == "bf16" and rows["a"]["file_dtype"] == "U8"
    assert [(r["key"], r["value"]) for r in flat.file_metadata(spark, str(two)).collect()] == [("version", "1.0")]


def test_sources_by_name(spark, two):
    spark.dataSource.register(flat.FlatShards)
    got = spark.read.format("flat_shards").option("engine", "sync").load(str(two))
    want = flat.catalog(spark, str(two)).drop("stride", "path")
    assert not ops.symmetric_difference(got.drop("path"), want).collect()


def test_bytes_in_chunks(spark, two):
    chunks = flat.read_bytes(flat.catalog(spark, str(two)), chunk_bytes=3).orderBy("name", "chunk_no").collect()
    by = {}
    for c in chunks:
        by[c["name"]] = by.get(c["name"], b"") + bytes(c["data"])
    assert by["b"] == bytes(range(5, 13)) and by["a"] == bytes([1, 2, 3, 4]) and by["empty"] == b""
    assert ops.touched(flat.read_bytes(flat.catalog(spark, str(two)))).first()["n_bytes"] == 20


def test_paths(spark, tmp_path, two):
    with pytest.raises(FileNotFoundError):
        flat.catalog(spark, str(tmp_path / "absent"))
    with pytest.raises(NotADirectoryError):
        flat.catalog(spark, str(two / "note.txt"))
    (tmp_path / "none").mkdir()
    with pytest.raises(flat.NoShards):
        flat.catalog(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="unsupported backend: x"):
        model.open_flat(spark, str(two), "x")


@pytest.mark.parametrize("n", [1, 2, 8])
def test_convert(spark, two, tmp_path, n):
    out = tmp_path / "out"
    stats = convert.Converter(n).convert(spark, str(two), str(out)).first()
    assert (stats["tensor_count"], stats["total_bytes"], stats["partition_count"], stats["source_file_count"]) == (5, 20, n, 2)
    index = json.loads((out / "tensor_index.json").read_text())
    was, now = model.load_flat(spark, str(two)), model.load_indexed(spark, str(out))
    assert set(was) == set(now) == set(index)
    assert all(np.array_equal(was[k], now[k]) and was[k].shape == now[k].shape for k in was)
    for p in {e[5] for e in index.values()}:
        ends = 0
        for e in sorted((e for e in index.values() if e[5] == p), key=lambda e: (e[0], e[1])):
            assert e[0] == ends
            ends += e[1]
        path = out / f"tensor.data_{p}"
        assert path.stat().st_size == ends
    assert not list(out.glob("*.part"))
    before = (out / "tensor_index.json").read_bytes()
    convert.Converter(n).convert(spark, str(two), str(out))
    assert (out / "tensor_index.json").read_bytes() == before


def test_same_folder_and_cache(spark, two):
    convert.ensure_converted(spark, str(two), str(two))
    assert (two / "a_shard.safetensors").exists() and (two / "tensor.data_0").stat().st_size == 20
    (two / "tensor.data_0").unlink()
    convert.ensure_converted(spark, str(two), str(two))
    assert not (two / "tensor.data_0").exists()


def test_refused(spark, two, tmp_path):
    with pytest.raises(ValueError):
        convert.Converter(0)
    shard(two / "m.safetensors", {"a": ("U8", [1], b"a")})
    with pytest.raises(validate.ViolationError, match="duplicate_name: a"):
        convert.Converter(1).plan(spark, str(two))
    (two / "m.safetensors").unlink()
    (two / "model.safetensors.index.json").write_text('{"weight_map":{"a":"other.safetensors"}}')
    with pytest.raises(validate.ViolationError, match="manifest_mismatch"):
        convert.Converter(1).plan(spark, str(two))
    (two / "model.safetensors.index.json").write_text('{"weight_map":{"a":"a_shard.safetensors","b":"z_shard.safetensors","n":3}}')
    convert.Converter(1).plan(spark, str(two))
    (two / "model.safetensors.index.json").write_text("{}")
    with pytest.raises(validate.ViolationError, match="manifest_broken"):
        convert.Converter(1).plan(spark, str(two))
    (two / "model.safetensors.index.json").unlink()
    shard(two / "m.safetensors", {"odd": ("F8_E4M3", [1], b"a")})
    with pytest.raises(validate.ViolationError, match="unknown_dtype"):
        convert.Converter(1).plan(spark, str(two))


def test_index_rules(spark, tmp_path):
    assert indexed.parse_entry("t", [4, 2, [1, 2], [2, 1], "I8", 3]) == ("t", 4, 2, [1, 2], [2, 1], "i8", 3)
    for bad in ([0, 4, [1], [1], "f32"], [0, 4, [1], [1, 1], "f32", 0], [(1 << 64) - 1, 4, [1], [1], "f32", 0], [0, 4, [1], [1], "q8", 0]):
        with pytest.raises(ValueError):
            indexed.parse_entry("t", bad)
    doc = spark.createDataFrame([('{"a":[0,4,[4],[1],"u8",0],"b":[1,2,[1],[1],"u8"],"c":[0,1,[1],[1,1],"u8",0],"d":[0,1,[],[],"q",0],"a":[4,1,[],[],"F",1]}',)], "value string")
    rows = [(r["name"], r["problem"]) for r in indexed.decode_index(doc).collect()]
    assert sorted(rows, key=str) == sorted([("a", None), ("a", None), ("b", "an entry has six fields"), ("c", "shape and stride differ in rank"), ("d", "unknown dtype")], key=str)
    with pytest.raises(indexed.BadIndex):
        sinks.save_indexed([], [b""], str(tmp_path))
    with pytest.raises(indexed.BadIndex):
        sinks.save_indexed([dict(name="w", offset=0, size=4, shape=[2, 2], stride=[2, 1], dtype="f32", partition_id=5)], [b"1234"], str(tmp_path))
    sinks.save_indexed([dict(name="w", offset=0, size=4, shape=[1], stride=[1], dtype="f32", partition_id=0), dict(name="far", offset=2, size=9, shape=[1], stride=[1], dtype="f32", partition_id=0)], [b"\x00\x00\x80\x3f"], str(tmp_path / "c"))
    c = model.open_indexed(spark, str(tmp_path / "c"))
    assert c.listed("far") and "far" not in c and c.get("far") is None and c.get("w").tolist() == [1.0] and c.keys() == ["far", "w"]


def test_flat_sinks(spark, two, tmp_path):
    tensors = {"x": np.arange(6, dtype=np.int64).reshape(2, 3), "y": np.array(1.5, np.float32), "z": ([2], "BF16", b"\x80\x3f\x00\x40"), "t": np.array([True, False])}
    (tmp_path / "m").mkdir()
    model.save_flat(tensors, str(tmp_path / "m" / "x.safetensors"), {"a": "b"})
    back = model.load_flat(spark, str(tmp_path / "m"))
    assert back["x"].tolist() == [[0, 1, 2], [3, 4, 5]] and back["y"].shape == () and back["z"].tolist() == [1.0, 2.0] and back["t"].tolist() == [True, False]
    with pytest.raises(ValueError):
        model.save_flat_bytes({})
    with pytest.raises(ValueError):
        model.save_flat_bytes({"f": ([1], "F8_E4M3", b"a")})
    from pyspark.sql import functions as F

    moved = flat.catalog(spark, str(two)).withColumn("file", F.concat(F.lit("part"), (F.length("name") % 2).cast("string"), F.lit(".safetensors")))
    n = sinks.write_flat(moved.select("file", "name", "file_dtype", "shape", "size", "path", "offset"), str(tmp_path / "w")).collect()
    assert len(n) == 2
    was, now = model.load_flat(spark, str(two)), model.load_flat(spark, str(tmp_path / "w"))
    assert set(was) == set(now) and all(np.array_equal(was[k], now[k]) for k in was)


@pytest.mark.parametrize("name", ["bool", "u8", "i8", "i16", "u16", "f16", "f32", "f64", "i32", "i64", "u32", "u64"])
def test_codecs(name):
    a = np.array([0, 1, 1, 0], dtypes._NUMPY[name])
    shape, spelling, data = dtypes.encode(a)
    assert dtypes.from_file(spelling) == name and len(data) == 4 * dtypes.WIDTHS[name] and np.array_equal(dtypes.decode(data, name, shape), a)


def test_dtype_names():
    assert [dtypes.parse(x) for x in ("F", "d", "B", "BF16")] == ["f32", "f64", "bool", "bf16"]
    with pytest.raises(dtypes.UnknownDtype):
        dtypes.parse("q4")
    assert dtypes.framework_name("torch.bfloat16") == "bfloat16" and dtypes.framework_name("F8_E5M2") == "float8_e5m2" and dtypes.framework_name("half") is None
    assert dtypes.saved_spelling("complex64") == "C64" and dtypes.to_file("unknown") == "F32"
    with pytest.raises(ValueError):
        dtypes.saved_spelling("F8_E4M3")
    x = np.array([1.0, -2.5, np.nan, 3e38], np.float32)
    back = dtypes.decode(dtypes.encode(x, "bf16")[2], "bf16")
    assert back[0] == 1 and back[1] == -2.5 and np.isnan(back[2])


def test_lazy_items(spark, two):
    c = model.open_flat(spark, str(two))
    assert [k for k, _ in c.items()] == sorted(["a", "b", "half", "empty", "scalar"]) and len(c) == 5 and c.is_lazy() and not c.is_empty()
    assert c.get("scalar").item() == 42 and c.get("absent") is None and "a" in c and c.meta("a")["size"] == 4
    with pytest.raises(ValueError, match="unsupported framework"):
        c.get("a", "jax")


@pytest.mark.parametrize("chunk_bytes,n", [(3, 1), (3, 3), (7, 2), (64 << 20, 2)])
def test_many_chunks(spark, tmp_path, chunk_bytes, n):
    """Tensors whose sizes are no multiple of a chunk, equal sizes, one byte more than a chunk, and empty ones, byte for byte."""
    d = tmp_path / "in put"
    d.mkdir()
    data = {f"t{i}": bytes((i * 31 + k) % 251 for k in range(size)) for i, size in enumerate([10, 3, 4, 0, 1000, 1000, 7, 1, 0, 299])}
    names = sorted(data)
    for f in range(3):
        shard(d / f"{f}.safetensors", {k: ("U8", [len(data[k])], data[k]) for k in names[f::3]})
    convert.Converter(n, chunk_bytes=chunk_bytes).convert(spark, str(d), str(tmp_path / "o ut"))
    index = json.loads((tmp_path / "o ut" / "tensor_index.json").read_text())
    files = {p: (tmp_path / "o ut" / f"tensor.data_{p}").read_bytes() for p in {e[5] for e in index.values()} if (tmp_path / "o ut" / f"tensor.data_{p}").exists()}
    assert {k: files.get(e[5], b"")[e[0] : e[0] + e[1]] for k, e in index.items()} == data
    assert sum(map(len, files.values())) == sum(map(len, data.values()))
    from pyspark.sql import functions as F

    moved = flat.catalog(spark, str(d)).withColumn("file", F.concat(F.lit("p"), (F.col("size") % 2).cast("string"), F.lit(".safetensors")))
    sinks.write_flat(moved, str(tmp_path / "again"), {"k": "v"}, chunk_bytes).collect()
    assert {k: v.tobytes() for k, v in model.load_flat(spark, str(tmp_path / "again")).items()} == data


def test_a_tensor_over_the_usual_chunk(spark, tmp_path):
    """64 MiB and a bit: two chunks of the size that converters use."""
    d = tmp_path / "in"
    d.mkdir()
    big = np.arange((64 << 20) // 4 + 250, dtype=np.uint32)
    model.save_flat({"big": big, "small": np.arange(5)}, str(d / "x.safetensors"))
    convert.Converter(1).convert(spark, str(d), str(tmp_path / "out"))
    assert np.array_equal(model.open_indexed(spark, str(tmp_path / "out")).get("big"), big)


def test_ranges_of_files(tmp_path):
    from shardlore.sources import files

    p = tmp_path / "a b.bin"
    p.write_bytes(bytes(range(100)))
    assert files.read_file(str(p)) == files.map_file(f"file:{p}").to_pybytes() == bytes(range(100))
    assert files.read_ranges(f"file://{p}", [(90, 10), (0, 2)]) == [bytes(range(90, 100)), b"\0\1"]
    with pytest.raises(EOFError):
        files.read_ranges(str(p), [(95, 10)])
    assert [x[1:] for x in files.children(str(tmp_path))] == [("a b.bin", 100)] and files.map_file(str(tmp_path / "a b.bin")).size == 100


def test_default_file_system(spark, two, tmp_path):
    """Paths without a scheme are made full ones before tasks get them."""
    from shardlore.sources.files import qualified

    assert qualified(spark, str(two)) == f"file:{two}"
    assert all(r["path"].startswith("file:/") for r in flat.catalog(spark, str(two)).collect())


def test_wide_types(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    c = np.array([1 + 2j, -3.5j], np.complex64)
    shard(d / "x.safetensors", {"c": ("C64", [2], c.tobytes()), "e4": ("F8_E4M3", [2, 3], bytes([0x00, 0x38, 0xB8, 0x7E, 0x01, 0x7F])), "e5": ("F8_E5M2", [4], bytes([0x3C, 0xBC, 0x7B, 0x7C])), "none": ("F8_E4M3", [0], b"")})
    got = model.load_flat(spark, str(d))
    assert got["c"].dtype == np.complex64 and np.array_equal(got["c"], c) and got["none"].shape == (0,)
    assert got["e4"].shape == (2, 3) and got["e4"].ravel()[:5].tolist() == [0, 1, -1, 448, 2.0**-9] and np.isnan(got["e4"][1, 2])
    assert got["e5"].tolist() == [1, -1, 57344, np.inf]
    assert np.array_equal(dtypes.decode(model.encode(c)[2], "C64"), c)
    with pytest.raises(ValueError, match="no device"):
        model.open_flat(spark, str(d)).get("c", device="cuda:0")
    assert [model.tf_device(x) for x in ("cpu", "cuda:1", "gpu", "/GPU:3")] == ["/CPU:0", "/GPU:1", "/GPU:0", "/GPU:3"]


def test_frameworks(spark, two, monkeypatch):
    """With a stand-in for the library, which isn't here: its own types, shapes and devices are asked for."""
    import sys
    import types

    class Tensor:
        def __init__(self, data, dtype, shape=None, device="cpu"):
            self.data, self.dtype, self.shape, self.device = data, dtype, shape, device

        def reshape(self, shape):
            return Tensor(self.data, self.dtype, shape, self.device)

        def to(self, device):
            return Tensor(self.data, self.dtype, self.shape, device)

    fake = types.ModuleType("torch")
    fake.__getattr__ = lambda name: name
    fake.frombuffer = lambda b, dtype: Tensor(bytes(b), dtype)
    fake.zeros = lambda shape, dtype: Tensor(b"", dtype, shape)
    fake.__spec__ = __import__("importlib.machinery").machinery.ModuleSpec("torch", None)
    monkeypatch.setitem(sys.modules, "torch", fake)
    monkeypatch.delitem(sys.modules, "shardlore.torch", raising=False)
    import importlib

    own = importlib.import_module("shardlore.torch")
    got = own.load_flat(spark, str(two))
    assert (got["half"].dtype, got["half"].shape, got["half"].data) == ("bfloat16", [2], b"\x80\x3f\x00\x40") and got["empty"].shape == [0, 2] and got["scalar"].shape == []
    assert dict(own.iter_flat(spark, str(two), device="cuda:0"))["a"].device == "cuda:0"
    monkeypatch.delitem(sys.modules, "shardlore.torch", raising=False)


def test_writers_by_name(spark, two, tmp_path):
    spark.dataSource.register(flat.FlatShards)
    spark.dataSource.register(indexed.TensorIndex)
    rows = [(f"t{i}", "U8", [i], bytes([i]) * i) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, file_dtype string, shape array<long>, data binary").repartition(3)
    df.write.format("flat_shards").mode("append").option("max_shard_bytes", 100).save(str(tmp_path / "f"))
    assert {k: v.tobytes() for k, v in model.load_flat(spark, str(tmp_path / "f")).items()} == {r[0]: r[3] for r in rows} and len(list((tmp_path / "f").glob("*.safetensors"))) > 6
    df.where("name < 't2'").write.format("flat_shards").mode("overwrite").save(str(tmp_path / "f"))
    assert set(model.load_flat(spark, str(tmp_path / "f"))) == {r[0] for r in rows if r[0] < "t2"} and not list((tmp_path / "f").glob(".*.part"))
    df.withColumnRenamed("file_dtype", "dtype").write.format("tensor_index").mode("append").save(str(tmp_path / "i"))
    assert {k: v.tobytes() for k, v in model.load_indexed(spark, str(tmp_path / "i")).items()} == {r[0]: r[3] for r in rows}
    with pytest.raises(Exception, match="names that differ"):
        df.union(df).withColumnRenamed("file_dtype", "dtype").write.format("tensor_index").mode("append").save(str(tmp_path / "j"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("flat_shards").option("pushdown", "true").load(str(tmp_path / "f")).where("name = 't11'").collect()
        some = spark.read.format("tensor_index").option("pushdown", "true").load(str(tmp_path / "i")).where("name in ('t3', 't30') and size > 3").collect()
        ids = spark.read.format("tensor_index").option("pushdown", "true").load(str(tmp_path / "i")).where("partition_id = 0").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert [r["name"] for r in got] == ["t11"] and [r["name"] for r in some] == ["t30"] and ids and all(r["partition_id"] == 0 for r in ids)


def test_save_indexed(spark, tmp_path):
    tensors = {"x": np.arange(6, dtype=np.int64).reshape(2, 3), "y": np.array(1.5, np.float32), "z": np.zeros((0, 2), np.float16)}
    model.save_indexed(tensors, str(tmp_path / "o"), 2)
    back = model.load_indexed(spark, str(tmp_path / "o"))
    assert all(np.array_equal(back[k], tensors[k]) and back[k].shape == tensors[k].shape for k in tensors)
    assert [k for k, _ in model.iter_indexed(spark, str(tmp_path / "o"))] == ["x", "y", "z"]


def test_kinds_of_violations(spark):
    index = spark.createDataFrame([("a", 0, 10, [10], 0), ("b", 10, 10, [10], 0), ("c", 0, 5, [5], 1), ("e", -1, 1 << 40, [1], 2)], "name string, offset long, size long, shape array<long>, partition_id int")
    files = spark.createDataFrame([(0, 15), (2, 1 << 41)], "partition_id int, length long")
    kind = lambda df: [tuple(r) for r in df.collect()]
    assert kind(validate.tensors_not_found(index, spark.createDataFrame([("a",), ("x",)], "name string"))) == [("tensor_not_found", "x", "")]
    assert kind(validate.partitions_not_found(index, files)) == [("partition_not_found", "1", "")]
    assert kind(validate.partitions_too_small(index, files)) == [("partition_too_small", "0", "15 20")]
    assert kind(validate.sizes_too_large(index)) == [("size_too_large", "e", str(1 << 40))]
    assert kind(validate.invalid_metadata(index)) == [("invalid_metadata", "e", f"-1 {1 << 40}")]
    texts = spark.createDataFrame([("m", '{"a":[0,4,[4],[1],"u8",0],"b":[1]}'), ("n", "{oops")], "doc string, value string")
    assert kind(validate.unparsed(texts, "doc", "value")) == [("json_parse_error", "n", "{oops")]
    assert kind(validate.invalid_entries(indexed.decode_index(texts.where("doc = 'm'")))) == [("invalid_index_format", "b", "an entry has six fields")]
    assert sorted(kind(validate.invalid_paths(spark.createDataFrame([("ok.bin",), ("../x",), ("",)], "file string")))) == [("path", "", ""), ("path", "../x", "")]
    bad = spark.createDataFrame([("", "U8", b""), ("f", "F8_E4M3", b"a"), ("n", "U8", None), ("ok", "U8", b"")], "name string, file_dtype string, data binary")
    assert sorted(r[2] for r in kind(validate.invalid_input(bad))) == ["dtype F8_E4M3", "no bytes", "no name"]
