"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

Letters of the whole text in lower case, other runs as one space, give n-grams of 1 to 4 characters, hashed to DIM places; their
square-rooted counts times IDF, at length 1, are the vector. Each language has up to CENTROIDS centroids, clustered by
spherical k-means from a bounded sample of labelled rows; IDF counts all labelled rows. A document gets the language of the nearest centroid; it is
rejected (a column of its own) where its cosine lies below REJECT times the least that the language's own samples show at
such a length. Vectors are built and compared in the scan's own task; centroids are a few hundred KB a language,
whatever the input, and nothing else is shipped.

Defined cases: `und`, score 0 and rejected if the text is null or has no letter, or nothing was learned; rows without
lang, text or letters teach nothing; a null doc_id is not held out and passes through; repeated rows are predicted alike.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylake.llm.common import handed_back, held_out, load, materialize, spread, tidy

FOLDS, DIM_BITS, ORDERS, CENTROIDS = 4, 14, 4, 4
DIM = 1 << DIM_BITS
#: Each language learns from at most so many labelled rows, those with the smallest hash of id and text.
SAMPLE = 1000
REJECT, SHARPNESS, UNKNOWN = 0.5, 25.0, "und"
#: Vectors built at once: DIM numbers each.
AT_ONCE = 64
#: Lengths, in letters, at which the least cosine is taken: 16, 32, ... 2048.
LENGTHS = [16 << i for i in range(8)]
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
ODD, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def letters(text: str | None) -> str:
    """Lower-case letters (and marks on them) with single spaces round and between their runs; empty if there is no letter."""
    if not text or not LETTER.search(text):
        return ""
    found = OTHER.sub(" ", text.lower()).strip()
    return f" {found} "


def counts(found: str) -> np.ndarray:
    """Counts of hashed n-grams, all orders together."""
    code = np.frombuffer(found.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    gram, all_ = code, []
    for order in range(ORDERS):
        if order:
            if len(gram) < 2:
                break
            gram = gram[:-1] * ODD + code[order:]
        all_.append(((gram + np.uint64(order)) * SPREAD) >> np.uint64(64 - DIM_BITS))
    return np.bincount(np.concatenate(all_).astype(np.int64), minlength=DIM)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1, in place; some at a time, as their squares take twice the rows' own memory."""
    for at in range(0, len(rows), AT_ONCE):
        some = rows[at : at + AT_ONCE]
        some /= np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-9)
    return rows


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.sqrt(counts(t))
    out *= idf.astype(np.float32)
    return unit(out)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # [centroids, LENGTHS]: the least cosine of the language's own samples

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, of each text."""
        found = [letters(t) for t in texts]
        known = np.array([bool(t) for t in found]) & bool(self.langs)
        if not known.any():
            return [UNKNOWN] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
        names = sorted(set(self.langs))
        by = np.array([names.index(x) for x in self.langs])
        cosine = vectors(found, self.idf) @ self.centroids.T
        best = np.stack([cosine[:, by == i].max(1) for i in range(len(names))], axis=1)
        pick = best.argmax(1)
        share = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        score = np.where(known, share.max(1) / share.sum(1), 0.0)
        size = np.clip([int(np.log2(max(len(t), 16) / 16)) for t in found], 0, len(LENGTHS) - 1)
        limit = REJECT * self.least[cosine.argmax(1), size]
        return [names[p] if k else UNKNOWN for p, k in zip(pick, known, strict=True)], score, ~known | (best.max(1) < limit)


def cluster(rows: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at the row nearest the mean, then at the row farthest from those chosen."""
    chosen = [int((rows @ rows.mean(0)).argmax())]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(1).argmin()))
    middle = rows[chosen]
    for _ in range(rounds):
        near = (rows @ middle.T).argmax(1)
        middle = unit(np.stack([(near == i).astype(np.float32) @ rows if (near == i).any() else middle[i] for i in range(len(middle))]))
    return middle


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Learns from docs (doc_id, text, lang): SAMPLE rows a language at most."""
    marked = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").alias("_id"), "text", "lang")
    # first a share of rows by hash, about twice the sample, then exactly the smallest hashes of these
    many = {r["lang"]: r["n"] for r in marked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return Model([], np.zeros((0, DIM), np.float32), np.ones(DIM), np.zeros((0, len(LENGTHS))))
    part = F.pmod(F.xxhash64("_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = spark.createDataFrame([(k, min(1.0, (2.0 * SAMPLE + 100) / n)) for k, n in many.items()], "_lang string, share double")
    some = marked.withColumn("_part", part).join(F.broadcast(share), (F.col("lang") == F.col("_lang")) & (F.col("_part") <= F.col("share")))
    order = Window.partitionBy("lang").orderBy("_part", "_id", "text")
    some = materialize(spark, some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE).select("lang", "text"), "langid-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                if found := letters(text):
                    n += 1
                    df += counts(found) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], df]))], ["place", "df"])

    # over all rows; place -1 holds the number of rows
    places = marked.select("text").mapInArrow(tidy(frequencies), "place bigint, df bigint")
    got = {r["place"]: r["df"] for r in places.groupBy("place").agg(F.sum("df").alias("df")).collect()}
    idf = np.log((1 + got.get(-1, 0)) / (1 + np.array([got.get(i, 0) for i in range(DIM)]))) + 0.1

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts = [x for t in sorted(table["text"].to_pylist()) if (x := letters(t))]
        if not texts:
            return pa.table({"lang": [], "centroid": [], "least": []}, schema)
        middle = cluster(vectors(texts, idf))
        least = []
        for n in LENGTHS:
            cuts = [t[i * 7 % (len(t) - n) :][:n] for i, t in enumerate(texts) if len(t) > n] or texts
            least.append(min(float((vectors(cuts[at : at + AT_ONCE], idf) @ middle.T).max(1).min()) for at in range(0, len(cuts), AT_ONCE)))
        handed_back()
        return pa.table({"lang": [key[0].as_py()] * len(middle), "centroid": [*middle.astype(np.float32)], "least": [least] * len(middle)}, schema)

    schema = pa.schema([("lang", pa.string()), ("centroid", pa.list_(pa.float32())), ("least", pa.list_(pa.float64()))])
    rows = some.groupBy("lang").applyInArrow(fit, "lang string, centroid array<float>, least array<double>").orderBy("lang", "centroid").collect()
    return Model([r["lang"] for r in rows], np.array([r["centroid"] for r in rows], np.float32).reshape(-1, DIM), idf, np.array([r["least"] for r in rows]).reshape(-1, len(LENGTHS)))


def identified(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, rejected."""
    shipped = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                lang, score, rejected = shipped.value.predict(some["_text"].to_pylist())
                yield pa.RecordBatch.from_arrays([some["_id"], some["_held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("_id"), held_out(F.col("doc_id"), FOLDS).alias("_held_out"), F.col("text").alias("_text"))
    return chosen.mapInArrow(tidy(predict), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def filtered(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    shipped = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                yield some.filter(pa.array(~shipped.value.predict(some.column(place).to_pylist())[2]))

    return docs.mapInArrow(tidy(keep), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(spark, spread(docs), train(spark, docs.where(~held_out(F.col("doc_id"), FOLDS))))
