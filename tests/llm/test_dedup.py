import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlore.llm.components import components
from shardlore.llm.jaccard import depth, similar
from shardlore.llm.substrings import remove_repeats
from shardlore.llm.suffixes import remove_substrings
from shardlore.llm.tablets import tidy

from . import brute

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1, near=60):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows, base, passage = [], text(90).split(), text(40)
    for _ in range(40):
        rows.append(text(r.randint(1, 120)))
    for _ in range(near):  # one large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append(" ".join(w[r.randint(0, 3) :]))
    rows += [" ".join(base)] * 15 + [text(30) + " " + passage + "\n" + text(r.randint(0, 60)) for _ in range(25)]
    rows += ["", None, "   \n\t ", "one", "One", "one two three four", "a b c d e", "xyz, " * 200, "xyz, " * 300, "é" * 150 + " ü", "q" * 400, "Ünï çødé " * 40]
    rows += rows[:10]
    r.shuffle(rows)
    ids = r.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 7, b"z") for i, t in rows], "doc_id long, text string, tablet string, n int, content binary").repartition(3)
    yield rows, df
    tidy(spark)


@pytest.mark.parametrize("tablet_bytes", [4 << 20, 3000])
def test_substrings(data, tablet_bytes):
    rows, df = data
    got = remove_substrings(df, tablet_bytes=tablet_bytes).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.substrings(rows)


def test_common_anchors(data, monkeypatch):
    """Anchors of two occurrences count as common, in this process and in the workers, which get the function by value."""
    from pyspark import cloudpickle as own

    from shardlore.llm import suffixes

    rows, df = data
    monkeypatch.setattr(suffixes, "HOT", 2)
    for most in (4096, 3, 0):  # no further cuts, some, and all down to single strings
        monkeypatch.setattr(suffixes, "MOST", most)
        own.register_pickle_by_value(suffixes)
        try:
            got = suffixes.remove_substrings(df, tablet_bytes=3000).withColumn("sha", F.sha2("kept", 256)).collect()
        finally:
            own.unregister_pickle_by_value(suffixes)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.substrings(rows)


@pytest.mark.parametrize("tablet_bytes", [4 << 20, 3000])
def test_windows(data, tablet_bytes):
    rows, df = data
    got = remove_repeats(df, tablet_bytes=tablet_bytes).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute.windows(rows)


@pytest.mark.parametrize("tablet_bytes", [4 << 20, 3000])
def test_classes(data, tablet_bytes):
    rows, df = data
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar(df, tablet_bytes=tablet_bytes).collect()}
    assert got == brute.classes(rows)


@pytest.mark.parametrize("verify", [0.0, 0.02, 50.0])
def test_groups_on_the_edge(spark, monkeypatch, verify):
    """Many copies with so many changes that some are just similar and some just not, of several sizes, and with every depth of prefix."""
    from pyspark import cloudpickle as own

    from shardlore.llm import jaccard

    r = random.Random(5)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(r.choice([30, 60, 100]))]
        for _ in range(60):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"n{r.randrange(30)}"
            rows.append(" ".join(w[r.randint(0, 6) : len(w) - r.randint(0, 6)]))
    line = " ".join(f"common{i}" for i in range(40))
    rows += [line + " " + " ".join(f"{k}x{i}" for i in range(r.randint(6, 20))) for k in range(80)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(jaccard, "VERIFY", verify)
    own.register_pickle_by_value(jaccard)
    try:
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tablet_bytes=9000).collect()}
    finally:
        own.unregister_pickle_by_value(jaccard)
    want = brute.classes(rows)
    assert got == want and len(set(want.values())) > 20


def test_depth():
    """Few long lists are not worth more shared shingles, many are; what is in one document costs nothing."""
    at = lambda rare: depth(100, np.array([1] * rare + [60] * (100 - rare)), 75)
    assert at(100) == at(15) == at(14) == 1 and 1 < at(11) < at(4) == 4


def thue_morse(k):
    t = [0]
    for _ in range(k):
        t += [1 - x for x in t]
    return t


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words, of letters and of words, and their complements."""
    t = thue_morse(10)
    letters = ["".join("ab"[x ^ y] for x in t) for y in (0, 1)]
    text = [" ".join(f"{letters[y]}{'' if i % 2 else 'z'}{i // 2}" for i in range(26)) for y in (0, 1)]
    plain = [" ".join(letters[y] for _ in range(13)) for y in (0, 1)]
    words = [" ".join(("left", "right")[x ^ y] for x in t) for y in (0, 1)]
    rows = list(enumerate([*plain, *text, *words, *letters, *letters]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in remove_repeats(df).withColumn("sha", F.sha2("kept", 256)).collect()} == brute.windows(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in remove_substrings(df).withColumn("sha", F.sha2("kept", 256)).collect()} == brute.substrings(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar(df).collect()} == brute.classes(rows)


def test_extreme_ids(spark):
    """The least and the greatest id are ids like others, and null is larger than both."""
    t = " ".join(f"v{i}" for i in range(60))
    low, high = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(None, t), (high, t), (low, t), (None, "x y"), (high, None)], "doc_id long, text string").repartition(2)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.n_removed) for r in remove_repeats(df).collect()) == order([(None, 60), (high, 60), (low, 0), (None, 0), (high, 0)])
    assert order((r.doc_id, r.n_removed) for r in remove_substrings(df).collect()) == order([(None, len(t)), (high, len(t)), (low, 0), (None, 0), (high, 0)])
    assert order((r.doc_id, r.component_id) for r in similar(df).collect()) == order([(None, low), (high, low), (low, low), (None, None), (high, high)])
    two = spark.createDataFrame([(None, t), (high, t)], "doc_id long, text string")
    assert order((r.doc_id, r.n_removed) for r in remove_repeats(two).collect()) == order([(None, 60), (high, 0)])


def test_very_long_texts(spark):
    """Texts longer than a tablet, which repeat each other and themselves."""
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(30_000))
    rows = [(1, long), (2, "start " + long[50_000:120_000] + " end"), (3, long), (4, "q" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {x.doc_id: (x.n_words, x.n_removed, x.sha) for x in remove_repeats(df, tablet_bytes=20_000).withColumn("sha", F.sha2("kept", 256)).collect()} == brute.windows(rows)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.sha) for x in remove_substrings(df, tablet_bytes=20_000).withColumn("sha", F.sha2("kept", 256)).collect()} == brute.substrings(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in similar(df, tablet_bytes=20_000).collect()} == brute.classes(rows)


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(None, t), (None, t), (3, t), (3, t), (5, None)], "doc_id long, text string")
    w = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(df).collect())
    assert w == [(-1, 60), (-1, 60), (3, 0), (3, 0), (5, 0)]
    s = sorted((r.doc_id or -1, r.n_removed) for r in remove_substrings(df).collect())
    assert s == [(-1, len(t)), (-1, len(t)), (3, 0), (3, len(t)), (5, 0)]
    c = sorted((r.doc_id or -1, r.component_id) for r in similar(df).collect())
    assert c == [(-1, 3), (-1, 3), (3, 3), (3, 3), (5, 5)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert not remove_repeats(df).collect() and not remove_substrings(df).collect() and not similar(df).collect()


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200 + r.randrange(50), 200 + r.randrange(50)) for _ in range(30)] + [(300, x) for x in range(301, 340)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if k != 100}


def test_rows_of_a_tablet(data, monkeypatch):
    """Tablets close at their number of rows, over Arrow batches too."""
    from pyspark import cloudpickle as own

    from shardlore.llm import tablets

    rows, df = data
    spark = df.sparkSession
    monkeypatch.setattr(tablets, "MOST_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    own.register_pickle_by_value(tablets)
    try:
        sizes = [len(tablets.Tablet(r.content).ids) for r in tablets.tablets(df).collect()]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar(df).collect()}
    finally:
        own.unregister_pickle_by_value(tablets)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(sizes) == 7 and sum(sizes) == len(rows)
    assert got == brute.classes(rows)
