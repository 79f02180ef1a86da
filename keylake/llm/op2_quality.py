"""Quality rules: fixed counts per document, then gradient-boosted trees over document statistics.

Statistics of a whole text are taken in the scan's own task, the forest (a few thousand numbers, whatever the
input) is shipped with the task, and nothing is shuffled. Training reads the statistics of at most TRAIN_ROWS
labelled documents, those with the smallest hash of their id.

Defined cases: a null text counts as empty and so fails the base rule; a null id passes through and has no label;
documents repeated in the table are judged one by one; a document with several labels takes their mean; with
no labels at all, or labels of one class, the forest is a constant and keeps what the base rule keeps if that class
is 1 or unknown; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm import gbt
from keylake.llm.common import binary, bounded_sample, load, spread, tidy

#: Training takes no more labelled documents than this.
TRAIN_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Documents are kept from this probability on.
KEEP_FROM = 0.5
SPACE, SYMBOLS, CAPITALS, DIGITS, ENDS = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".!?"
SMALL = bytes(range(97, 123))
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "exclaims", "distinct_words", "line_words", "top_word")
#: Quality never rises with these.
MONOTONE = {FEATURES.index(k): -1 for k in ("symbols", "dup_lines", "repeat_words", "capitals", "exclaims", "top_word")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more. ids: equal for equal words.

    Windows get exact ids by doubling: pairs of words, pairs of pairs, and so on. window is a power of 2.
    """
    code, span = ids, 1
    while span < window:
        if len(code) <= span:
            return 0
        code = np.unique(code[:-span] * (int(code.max()) + 1) + code[span:], return_inverse=True)[1]
        span *= 2
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a whole text."""
    text = text or b""
    words, without = text.split(), lambda chars: len(text) - len(text.translate(None, chars))
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    repeat = repeated_words(np.array(ids, np.int64)) if len(seen) < n and n > WINDOW else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    chars = len(text.decode("utf-8", "replace")) - without(SPACE)
    symbols, capitals, small = without(SYMBOLS), without(CAPITALS), without(SMALL)
    top = int(np.bincount(ids).max()) if n else 0
    m = max(n, 1)
    return [n, chars, symbols, dup, repeat], [np.log1p(n), chars / m, symbols / m, dup / max(len(lines), 1), repeat / m, capitals / max(capitals + small, 1), without(DIGITS) / m, text.count(b"!") / m, len(seen) / m, n / max(len(lines), 1), top / m]


def judged(texts: list[bytes | None], forest: gbt.Forest | None) -> dict[str, np.ndarray]:
    """COUNTS, base_failed and kept of each text; with no forest only the base rule counts."""
    both = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in both], np.int64).reshape(len(texts), len(COUNTS))
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    p = forest.probability(np.array([f for _, f in both], float).reshape(len(texts), len(FEATURES))) if forest and len(texts) else np.ones(len(texts))
    return dict(zip(COUNTS, counts.T, strict=True)) | {"base_failed": failed, "quality": p, "kept": ~failed & (p >= KEEP_FROM)}


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> gbt.Forest:
    """Fits the forest to docs (doc_id, text) and labels (doc_id, quality), on at most so many labelled documents."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("quality"))
    chosen = bounded_sample(marked, rows, "doc_id").groupBy("doc_id").agg(F.avg("quality").alias("quality"))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t)[1] for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "features"])

    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(tidy(stats), "doc_id bigint, quality double, features array<double>")
    got = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    x = np.array(got.features.tolist(), float).reshape(len(got), len(FEATURES))
    y = (got.quality.to_numpy(float) >= 0.5).astype(float)
    if len(y) and y.min() == y.max():
        return gbt.fit(x[:0], np.array([])) if y[0] else gbt.Forest(np.zeros((0, 15), np.int64), np.zeros((0, 15)), np.zeros((0, 16)), -5.0)
    return gbt.fit(x, y, trees=40, depth=4, monotone=MONOTONE)


def verdicts(docs: DataFrame, forest: gbt.Forest | None) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, quality (the forest's probability), kept."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judged(binary(batch, "text"), forest)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(found[k]) for k in (*COUNTS, "base_failed", "kept", "quality")]], ["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(judge), "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, quality double")


def filtered(docs: DataFrame, forest: gbt.Forest | None) -> DataFrame:
    """The documents kept, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judged(binary(batch, "text"), forest)["kept"]))

    return docs.mapInArrow(tidy(keep), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(spread(docs), train(docs, load(spark, sf_dir, "labels"))).drop("quality")
