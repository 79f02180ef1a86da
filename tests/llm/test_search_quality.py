import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keylake.llm import gbt, op1_topk, op2_quality


# op1 --------------------------------------------------------------------------------------------------------------------
def brute_top(vectors, queries, k):
    out = []
    for q, v in queries:
        found = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,span,k", [(1, 3, 5), (2, 3000, 5), (3, 1, 7), (4, 10**6, 1)])
def test_top_k_equals_brute_force(spark, seed, span, k):
    r = random.Random(seed)
    vectors = [(i, [r.randint(-span, span) for _ in range(6 if i % 17 else 4)]) for i in range(300)]
    queries = [(i, v) for i, v in vectors if i % 23 == 0]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    asked = spark.createDataFrame(queries, "query_id long, v array<long>")
    got = sorted(map(tuple, op1_topk.top_k(spark, rows, asked, k).collect()))
    assert got == brute_top(vectors, queries, k)


def test_top_k_cells(spark, monkeypatch):
    monkeypatch.setattr(op1_topk, "ROW_NUMBERS", 80)
    monkeypatch.setattr(op1_topk, "QUERY_NUMBERS", 20)
    r = random.Random(5)
    vectors = [(i, [r.randint(-9, 9) for _ in range(5)]) for i in range(100)]
    rows, queries = spark.createDataFrame(vectors, "vec_id long, v array<long>"), vectors[::9]
    got = op1_topk.top_k(spark, rows, spark.createDataFrame(queries, "query_id long, v array<long>"))
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, queries, 5)


def test_top_k_query_handles_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, 0.2], 7), (50, [0.5, -0.25], 7), (1, None, 7), (2, [None, 1.0], 7), (3, [nan, 1.0], 7), (4, [inf, 1.0], 7), (5, [1.0, 1.0], 7), (5, [1.0, 1.0], 7), (6, [1.0, 1.0], 7), (None, [1.0, 1.0], 7), (100, [], 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, op1_topk.query(spark, str(tmp_path)).collect()))
    base = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i in (0, 50, 5, 6)]
    assert got == brute_top(base, [r for r in base if r[0] in (0, 50)], 5) and [r[2] for r in got if r[0] == 0].count(5) == 2  # repeated rows count each
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({op1_topk.ORACLE_SQL})").fetchall()) == got


def test_top_k_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op1_topk.query(spark, str(tmp_path)).count() == 0


# op2 --------------------------------------------------------------------------------------------------------------------
def brute_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(inside)


def test_repeated_words():
    r = random.Random(3)
    for n, letters in itertools.product((0, 5, 8, 9, 17, 60), ("a", "ab", "abcd")):
        words = [r.choice(letters) for _ in range(n)]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert op2_quality.repeated_words(np.array([number[w] for w in words], np.int64)) == brute_repeats(words)


def test_statistics_of_a_text():
    counts, _ = op2_quality.statistics("é# b\n\n x\té$ |\né# b\n  \né# b".encode())
    assert dict(zip(op2_quality.COUNTS, counts)) == {"n_words": 9, "word_chars": 13, "n_symbols": 5, "n_dup_lines": 2, "n_repeat_words": 0}
    assert op2_quality.statistics(None)[0] == [0, 0, 0, 0, 0]
    assert op2_quality.statistics("a\xa0b\x1cc".encode())[0][:2] == [1, 5]  # other white space separates no words
    assert op2_quality.statistics(b"w " * 200_000)[0] == [200_000, 200_000, 0, 0, 200_000]


def test_forest_learns_and_stays_monotone():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 0]) > r.normal(0, 0.1, 4000)).astype(float)
    forest = gbt.fit(x, y, monotone={0: 1, 1: -1})
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.9
    for j, sign in ((0, 1), (1, -1)):
        base = np.repeat(r.random((50, 3)), 40, axis=0)
        base[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(forest.margin(base).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()
    assert gbt.fit(x[:0], y[:0]).margin(x).shape == (4000,)
    one = forest.margin(x[:1])
    assert np.allclose(one, forest.margin(x)[:1]) and forest.margin(x[:0]).shape == (0,)


def test_quality_on_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    forest = op2_quality.train(docs, labels.where(half == 0))
    judged = op2_quality.verdicts(docs, forest).drop("quality").where("NOT base_failed")
    got = judged.join(labels.where(half == 1).select("doc_id", "quality"), "doc_id").toPandas()
    assert len(got) > 50 and (got.kept == (got.quality == 1)).mean() > 0.97


def brute_statistics(text):
    """The counts and features of a text, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    among = lambda pattern: len(re.findall(pattern, text))
    chars, symbols, n = sum(map(len, words)), among(r"[#*$%&|<>]"), len(words)
    m, capitals = max(n, 1), among("[A-Z]")
    features = [math.log1p(n), chars / m, symbols / m, dup / max(len(lines), 1), len(inside) / m, capitals / max(capitals + among("[a-z]"), 1), among("[0-9]") / m, among("!") / m, len(set(words)) / m, n / max(len(lines), 1), max(Counter(words).values(), default=0) / m]
    return (n, chars, symbols, dup, len(inside)), features


def brute_kept(text, forest):
    """The counts, whether the base rule fails, and the verdict by a walk of each tree from its root."""
    counts, x = brute_statistics(text)
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    margin = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        margin += value[node - len(feature)]
    return (*counts, failed, not failed and bool(1 / (1 + math.exp(-margin)) >= 0.5))


def test_quality_query_equals_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest = op2_quality.train(docs, labels)
    want = sorted((r.doc_id, *brute_kept(r.text, forest)) for r in docs.collect())
    assert sorted(map(tuple, op2_quality.query(spark, sf).select("doc_id", *op2_quality.COUNTS, "base_failed", "kept").collect())) == want
    assert len(forest.feature) and {w[-1] for w in want} == {True, False} and any(w[-2] for w in want)


def test_quality_odd_rows(spark):
    good = "It was a fine day and the people of the town went out to see the river run by the old mill near the hill."
    rows = [(1, None), (2, ""), (None, good), (4, good), (4, good), (5, "a b " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = op2_quality.verdicts(docs, None)
    assert sorted((r.doc_id or 0, r.kept) for r in got.collect()) == [(0, True), (1, False), (2, False), (4, True), (4, True), (5, False)]
    empty = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (empty, spark.createDataFrame([(4, 1), (5, None)], "doc_id long, quality int")):
        assert op2_quality.filtered(docs, op2_quality.train(docs, labels)).columns == docs.columns
        assert op2_quality.filtered(docs, op2_quality.train(docs, labels)).count() == 3
    assert op2_quality.verdicts(docs.limit(0), None).count() == 0
    assert op2_quality.filtered(docs, op2_quality.train(docs, spark.createDataFrame([(4, 0)], "doc_id long, quality int"))).count() == 0
