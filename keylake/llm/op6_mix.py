"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes of sources give targets. The mix is cut into equal blocks of words; blocks go to sources by the highest
quotients target / (2 n + 1), which gives every source an integer quota, and a source's quota goes on to its shards
the same way, by shard size. A shard is a hash bucket of a source's documents, cut so that it holds about SHARD_WORDS
words: a hot source has many, so no task holds a source. In a shard, documents stand in seeded order and form one
circle of blocks; the quota is met by whole turns of the circle and one arc of blocks from a seeded start.
A document's share is therefore arithmetic on its place in the circle, and an arc takes whole documents but for two.

Only totals per source and per shard reach the driver (at most MOST_SHARDS rows and one a source); documents do not. Highest quotients are found by the
equal divisor rule (each claim rounds target / divisor), with ties going to the first claim in order.

Defined cases: a null or wordless text has size 0 and is taken 0 times; a null source is a source of its own, last
in order; sources without words have target 0; an empty table gives no rows; rows repeated with one doc_id count as
documents each, in an order that only their equal texts decide. Other columns pass through `mixed` and are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylake.llm.common import WORD, load, materialize, n_words, tidy

WEIGHTS, SHARE_PERCENT, MOST_TIMES, SEED = (3.0, 1.0, 2.0), 150, 2, 20240101
#: A shard holds about so many words, more where that would make over MOST_SHARDS shards; a block is a millionth of
#: the mix, from 1 to MOST_BLOCK words. A table of up to SMALL_TABLE sources is broadcast.
SHARD_WORDS, MOST_SHARDS, BLOCKS, MOST_BLOCK, SMALL_TABLE = 250_000, 50_000, 1_000_000, 64, 10_000


def targets(sizes: list[int], weights: list[float], percent: int = SHARE_PERCENT, times: int = MOST_TIMES) -> list[float]:
    """Words of each source in the mix: by weight, but times its size at most; what is cut off is shared again."""
    left, out, free = percent * sum(sizes) / 100, [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        level = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * level > times * sizes[i]}
        for i in full or free:
            out[i] = float(times * sizes[i]) if full else weights[i] * level
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def sainte_lague(claims: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats of each claim: the highest quotients claim / (2 n + 1), n counting from 0, with at most `most` seats each.

    Bisection finds a divisor at which rounding gives no more than all seats; the last seats go one by one.
    """
    seats = min(seats, sum(m for c, m in zip(claims, most, strict=True) if c > 0))
    given = lambda d: [min(m, int(c / d + 0.5)) if c > 0 else 0 for c, m in zip(claims, most, strict=True)]
    if seats <= 0:
        return [0] * len(claims)
    low, high = 0.0, max(claims) * 2 + 1  # at high nobody gets a seat; low is never used as a divisor
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if sum(given(middle)) <= seats else (middle, high)
    out = given(high)
    heap = [(-claims[i] / (2 * out[i] + 1), i) for i in range(len(claims)) if claims[i] > 0 and out[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-claims[i] / (2 * out[i] + 1), i))
    return out


def _random(*parts: Column | str | int) -> Column:
    return F.xxhash64(F.lit(SEED), *[F.lit(p) if isinstance(p, int) else p for p in parts])


def _plan(spark: SparkSession, sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals, target and shard count of each source; and of each of its shards the size, blocks and quota of blocks."""
    sources = sized.groupBy("_source").agg(F.sum("_size").alias("size")).orderBy(F.col("_source").asc_nulls_last()).collect()
    sizes = [r["size"] for r in sources]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    block = max(1, min(MOST_BLOCK, int(sum(goal)) // BLOCKS))
    words = max(SHARD_WORDS, sum(sizes) // MOST_SHARDS)
    shards = [max(1, -(-n // words)) for n in sizes]
    schema = "source string, source_size long, target double, shards int"
    table = spark.createDataFrame([(r["_source"], n, t, k) for r, n, t, k in zip(sources, sizes, goal, shards, strict=True)], schema)
    held = _dealt(sized, table).groupBy("_source", "_shard").agg(F.sum("_size").alias("n")).orderBy(F.col("_source").asc_nulls_last(), "_shard").collect()
    place = {r["_source"]: i for i, r in enumerate(sources)}
    pieces: list[list[tuple[int, int]]] = [[] for _ in sources]
    for r in held:
        pieces[place[r["_source"]]].append((r["_shard"], r["n"]))
    blocks = [[-(-n // block) for _, n in p] for p in pieces]
    quotas = sainte_lague(goal, round(sum(goal) / block), [MOST_TIMES * sum(b) for b in blocks])
    rows = []
    for r, p, b, q in zip(sources, pieces, blocks, quotas, strict=True):
        for (shard, n), k, mine in zip(p, b, sainte_lague([float(n) for _, n in p], q, [MOST_TIMES * k for k in b]), strict=True):
            rows.append((r["_source"], shard, n, k, mine))
    plan = spark.createDataFrame(rows, "p_source string, p_shard int, p_size long, p_blocks long, p_quota long")
    return table, plan.withColumn("p_block", F.lit(block).cast("long"))


def _dealt(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its source's row and its shard."""
    small = sources.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE
    table = (F.broadcast(sources) if small else sources).withColumnsRenamed({"source": "_of", "source_size": "_source_size", "target": "_target", "shards": "_shards"})
    found = sized.join(table, F.col("_source").eqNullSafe(F.col("_of")))
    return found.withColumn("_shard", F.pmod(_random("_id", "_text_hash"), F.col("_shards")).cast("int")).drop("_of", "_shards")


def _overlap(start: Column, end: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.least(end, b) - F.greatest(start, a), F.lit(0))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document: _row (all its columns), _id, _source, _size, _source_size, _target, _taken, and its place:

    _turns whole takes, and of one more take the words [_a, _b) and [0, _c), counted within the document.
    """
    key = [F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_text_hash")]
    sources, plan = _plan(spark, materialize(spark, docs.select(*key), "mix-sizes"))
    dealt = _dealt(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *key), sources)
    seeded = Window.partitionBy("_source", "_shard").orderBy(_random("_id", "_text_hash"), "_id", "_text_hash")
    placed = dealt.withColumn("_end", F.sum("_size").over(seeded.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per SHARD_WORDS words of the corpus: broadcast while Spark sees that it is small, else a join by shard
    placed = placed.join(plan, F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("_shard") == F.col("p_shard")))
    start, arc = F.col("_end") - F.col("_size"), F.when(F.col("p_blocks") > 0, F.col("p_quota") % F.greatest("p_blocks", F.lit(1))).otherwise(0)
    turn = F.pmod(_random("_source", "_shard"), F.greatest("p_blocks", F.lit(1)))
    # the arc's blocks [turn, turn + arc) on the circle, in words of the shard
    first, last = turn * F.col("p_block"), (turn + arc) * F.col("p_block")
    beyond = F.greatest(turn + arc - F.col("p_blocks"), F.lit(0)) * F.col("p_block")
    placed = placed.withColumns({"_turns": F.when(F.col("p_blocks") > 0, F.expr("p_quota div greatest(p_blocks, 1)")).otherwise(0), "_s": start, "_first": first, "_last": F.least(last, "p_size"), "_beyond": beyond})
    a, b = F.greatest("_s", "_first"), F.least("_end", "_last")
    placed = placed.withColumns({"_a": F.when(b > a, a - F.col("_s")).otherwise(0), "_b": F.when(b > a, b - F.col("_s")).otherwise(0), "_c": _overlap(F.col("_s"), F.col("_end"), F.lit(0), F.col("_beyond"))})
    taken = F.when(F.col("_size") > 0, F.col("_turns") * F.col("_size") + F.col("_b") - F.col("_a") + F.col("_c")).otherwise(0)
    return placed.select("_row", "_id", "_source", "_size", "_source_size", "_target", taken.cast("long").alias("_taken"), F.col("_turns").cast("long").alias("_turns"), "_a", "_b", "_c")


def passage(text: str, a: int, b: int) -> str:
    """From the start of word a to the end of word b - 1, white space between them as it stands."""
    at = [m.span() for m in re.finditer(WORD, text)]
    return text if (a, b) == (0, len(at)) else text[at[a][0] : at[b - 1][1]]


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each take of a document, its text cut to the words taken and n_chars to its length."""
    fields = docs.schema

    def takes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, size, a, b, c = (batch[k].to_pylist() for k in ("_turns", "_size", "_a", "_b", "_c"))
            rows = batch["_row"].flatten()
            texts = rows[fields.names.index("text")]
            at, cut = [], {}
            for i in range(len(turns)):
                spans = [(0, size[i])] * turns[i] + [(x, y) for x, y in ((a[i], b[i]), (0, c[i])) if y > x] if size[i] else []
                for x, y in spans:
                    if (x, y) != (0, size[i]):
                        cut[len(at)] = passage(texts[i].as_py(), x, y)
                    at.append(i)
            out = [x.take(pa.array(at, pa.int64())) for x in rows]
            if cut:
                k, n = fields.names.index("text"), fields.names.index("n_chars") if "n_chars" in fields.names else None
                whole = out[k].to_pylist()
                out[k] = pa.array([cut.get(i, t) for i, t in enumerate(whole)], out[k].type)
                if n is not None:
                    out[n] = pa.array([len(cut[i]) if i in cut else x for i, x in enumerate(out[n].to_pylist())], out[n].type)
            yield pa.RecordBatch.from_arrays(out, fields.names)

    return mix(spark, docs).where("_taken > 0").select("_row", "_turns", "_size", "_a", "_b", "_c").mapInArrow(tidy(takes), fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(spark, docs).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))
