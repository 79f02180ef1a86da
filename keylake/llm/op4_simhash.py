"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most four bits differ in at most four bytes, so they share at
least four of eight positional bytes: the guaranteed minimum. Postings of single positional bytes would hold a 256th of all
fingerprints each, so the inverted index is keyed by four positions and their bytes at once (70 keys a fingerprint): pairs
with fewer shared bytes meet nowhere. Where a pair meets, its shared positional bytes are tallied; pairs that reach the minimum are
retained, and of these the ones within four bits are verified links. A posting sends on a spanning forest of its links, at most
one link a member, never its pairs.

Only distinct fingerprints enter the index, so copies don't enlarge postings. A posting of over POSTING members (many near
copies) is not compared pairwise: its members all spell out the fingerprints within half the distance, and two that spell
out a common one are links exactly when their distance is at most four; this costs a fixed number of rows a member.

Defined cases: a null text is an empty one; documents without words have fingerprint zero and link like any other; a null
doc_id takes part in links, is returned with its component, and is never a component's id unless all its members'
ids are null (then component_id is null); rows repeated with one doc_id count as documents each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import binary, bounded_sample, freed, handed_back, load, lookup, materialize, parallelism, spread, tidy
from keylake.llm.components import components

SHINGLE, DISTANCE, SEED, BYTES, POSTING = 4, 4, 42, 8, 4096
#: The position sets of the guaranteed minimum: BYTES - DISTANCE positions each.
SETS = [sum(0xFF << (8 * p) for p in s) for s in combinations(range(BYTES), BYTES - DISTANCE)]
SIGNED = np.int64


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of a whole text, unsigned: a bit is set if it is in over half the shingles' hashes."""
    words = (text or b"").lower().split()  # lower() of bytes changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(width, len(words))
    ends = (ends - 1)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and the long columns to carry."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in binary(batch, "text")], np.uint64).astype(SIGNED)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps), *[batch[c] for c in carry]], ["doc_id", "fp", *carry])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    return chosen.mapInArrow(tidy(each), "doc_id bigint, fp bigint" + "".join(f", `{c}` bigint" for c in carry))


LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def shared_bytes(apart: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes that two fingerprints share, from their exclusive or."""
    return BYTES - np.bitwise_count((((apart & LOW) + LOW) | apart) & ~LOW)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints a and b (unsigned) are linked: the tally reaches the minimum, and the bits then agree."""
    apart = a ^ b
    near = shared_bytes(apart) >= BYTES - DISTANCE
    near[near] = np.bitwise_count(apart[near]) <= DISTANCE
    return near


def _forest(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: places, by breadth-first search in blocks."""
    root = np.full(len(bits), -1)
    a, b = [np.array([], np.int64)], [np.array([], np.int64)]
    for start in range(len(bits)):
        if root[start] >= 0:
            continue
        root[start] = start
        frontier = np.array([start])
        while len(frontier):
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                break
            new = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), 256):
                open_ = np.flatnonzero(~new)
                new[open_] = _near(bits[frontier[at : at + 256], None], bits[None, rest[open_]]).any(0)
            frontier = rest[new]
            root[frontier] = start
            a.append(frontier)
            b.append(np.full(len(frontier), start))
    return np.concatenate(a), np.concatenate(b)


def _spelled(fps: np.ndarray, within: int) -> np.ndarray:
    """All fingerprints within so many bits of each: [fingerprints, variants]."""
    masks = [sum(1 << i for i in s) for k in range(within + 1) for s in combinations(range(64), k)]
    return fps[:, None] ^ np.array(masks, np.uint64).view(SIGNED)[None, :]


def links(spark: SparkSession, distinct: DataFrame, posting: int = POSTING) -> DataFrame:
    """Links a, b among distinct fingerprints (fp) that have the same components as all pairs within DISTANCE bits."""
    sets = np.array(SETS, np.uint64).view(SIGNED)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for i, mask in enumerate(sets.tolist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int8)), pa.array(fps & mask), batch["fp"]], ["s", "key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by s, key: postings one after another. b is null for members of a posting over the size."""
        held = [np.array([], np.int8), np.array([], SIGNED), np.array([], SIGNED)]

        def links_of(s, key, fps):
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(s) != 0)) + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(fps)]])
            a, b, big = [], [], []
            sizes = last - first
            pair = first[sizes == 2]  # by far the most common
            if len(pair):
                x, y = fps[pair], fps[pair + 1]
                near = _near(x.view(np.uint64), y.view(np.uint64))
                a.append(x[near])
                b.append(y[near])
            for f, z in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if z > posting:
                    big.append(fps[f : f + z])
                else:
                    some = fps[f : f + z]
                    x, y = _forest(some.view(np.uint64))
                    a.append(some[x])
                    b.append(some[y])
            none = np.array([], SIGNED)
            a, b, big = (np.concatenate(x) if x else none for x in (a, b, big))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, big])), pa.concat_arrays([pa.array(b), pa.nulls(len(big), pa.int64())])], ["a", "b"])

        over = False  # the posting at hand is over the size and its first members are out already
        for batch in batches:
            s, key, fps = (np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("s", "key", "fp"), strict=True))
            if not len(fps):
                continue
            ended = np.flatnonzero((np.diff(key) != 0) | (np.diff(s) != 0))
            cut = int(ended[-1]) + 1 if len(ended) else 0
            if over and len(ended):  # the rest of the large posting
                n = int(ended[0]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(fps[:n]), pa.nulls(n, pa.int64())], ["a", "b"])
                s, key, fps, cut, over = s[n:], key[n:], fps[n:], cut - n, False
            if cut:
                yield links_of(s[:cut], key[:cut], fps[:cut])
            s, key, fps = s[cut:], key[cut:], fps[cut:]
            if over or len(fps) > posting:
                over = True
                yield pa.RecordBatch.from_arrays([pa.array(fps[1:]), pa.nulls(len(fps) - 1, pa.int64())], ["a", "b"])
                s, key, fps = s[:1], key[:1], fps[:1]
            held = [s, key, fps]
        if len(held[0]):
            if over:
                yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.nulls(len(held[2]), pa.int64())], ["a", "b"])
            else:
                yield links_of(*held)

    postings = distinct.select("fp").mapInArrow(tidy(index), "s tinyint, key bigint, fp bigint").repartition("s", "key").sortWithinPartitions("s", "key")
    found = materialize(spark, postings.mapInArrow(tidy(compare), "a bigint, b bigint").distinct(), "simhash-links")
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return found

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for at in range(0, len(fps), 64):
                some = _spelled(fps[at : at + 64], DISTANCE // 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps[at : at + 64], some.shape[1])), pa.array(some.ravel())], ["fp", "variant"])

    spelled = crowded.mapInArrow(tidy(spell), "fp bigint, variant bigint")
    least = spelled.groupBy("variant").agg(F.min("fp").alias("b"))
    meeting = spelled.join(least, "variant").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return found.where("b IS NOT NULL").union(meeting)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed long), root (the least fp of the component), component_id."""
    return grouped(spark, materialize(spark, fingerprints(docs), "simhash"), "fp", lambda distinct: links(spark, distinct))


def grouped(spark: SparkSession, each: DataFrame, key: str, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """each (doc_id, key and further columns) with root and component_id. linked gives the links a, b of distinct fingerprints.

    linked sees the key, fp (the key itself, or a number for each distinct key) and any PROFILE columns, keys and row.
    """
    carried = [c for c in (*PROFILE, "keys", "row") if c in each.columns]
    distinct = each.groupBy(key).agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), *[F.min(c).alias(c) for c in carried])
    distinct = distinct if key == "fp" else distinct.withColumn("fp", F.monotonically_increasing_id())
    distinct = materialize(spark, distinct, "simhash-distinct")
    found = components(spark, linked(distinct))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(key, "times", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(spark, rooted, "simhash-roots")
    ids = materialize(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-ids")
    total, nodes = distinct.agg(F.sum("times"), F.count("*")).first()
    classes = lookup(rooted.drop("least"), ids, "root", "n", nodes)
    return lookup(each.drop(*PROFILE, "keys", "mark"), classes, key, "times", total or 0)


# near copies of documents -----------------------------------------------------------------------------------------------
# Two documents are near copies if their sets of distinct five-word shingles have a Jaccard similarity of 0.8 or more. This is
# verified on the sets themselves. First come the links of the fingerprints above (the byte-position index, the tally, four
# bits), and what they hold is joined. Few pairs near 0.8 are within four bits, so further candidates between groups not joined
# so are those that share a key: a set of n shingles is keyed by the n - ceil(0.8 n) + 1 that come
# first in one order of all shingles, and sets that near each other always share one of these (prefix filter). The order
# puts shingles that a sample shows to be frequent last, so that passages in many documents are rarely keys. A
# fingerprint of 128 bits passes over candidates that are plainly far.

COPY_SHINGLE = 5
#: Of the 128 bits of a fingerprint; a similarity of 0.8 shows as 19 on average, with a deviation of 4. Small sets are all verified.
TIGHT_BITS, COPY_BITS, SMALL_SET = 23, 40, 32
#: Documents whose shingles are counted for the order, the least count that matters, and how many such shingles at most.
ORDER_ROWS, ORDER_COUNT, ORDER_SHINGLES = 10_000, 4, 200_000
#: A posting of more members sends a forest of candidate links, not all.
CROWD = 16
PROFILE = ["n", "v0", "v1"]
Order = tuple[np.ndarray, np.ndarray]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints [words] of hashes [features, words]."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(np.ascontiguousarray(hashes[at : at + 16384]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _hashes(text: bytes | None) -> np.ndarray:
    """Hashes of 128 bits [shingles, 2] of a text's distinct shingles, by the first word."""
    words = (text or b"").lower().split()
    k = min(COPY_SHINGLE, len(words))
    found = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
    wide = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([wide(x, 1) for x in found]), np.uint64).reshape(-1, 2)
    return hashes[np.argsort(hashes[:, 0])]


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.ascontiguousarray(_hashes(text)[:, 0])


def _profile(hashes: np.ndarray) -> list[int]:
    return [len(hashes), *_majority(hashes).tolist()] if len(hashes) else [0, 0, 0]


def profile(text: bytes | None) -> tuple[bytes, list[int]]:
    """A digest of the set of a text's shingles; its size, and two words of its fingerprint (zero without words)."""
    hashes = _hashes(text)
    return xxhash.xxh3_128_digest(hashes.tobytes()), _profile(hashes)


def row_key() -> Column:
    """128 bits that tell rows of different doc_id or text apart; rows repeated whole have the same."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def prefix(found: np.ndarray, order: Order) -> np.ndarray:
    """The keys of a set of shingles: those that come first in the order, as many as a set of 0.8 cannot lack."""
    n = len(found)
    if not n:
        return found
    frequent, counts = order
    at = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
    weight = np.where(frequent[at] == found, counts[at], 0) if len(frequent) else np.zeros(n, np.int64)
    return found[np.lexsort((found, weight))[: n - (4 * n + 4) // 5 + 1]]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of 0.8 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def shingle_order(spark: SparkSession, docs: DataFrame) -> Order:
    """Frequent shingles of a bounded sample, sorted, and their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in binary(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(SIGNED))], ["h"])

    some = bounded_sample(docs.select("doc_id", "text"), ORDER_ROWS, "doc_id", "text").select("text")
    counted = some.repartition(parallelism(spark)).mapInArrow(tidy(each), "h bigint").groupBy("h").agg(F.count("*").alias("c"))
    got = counted.where(F.col("c") >= ORDER_COUNT).orderBy(F.desc("c"), "h").limit(ORDER_SHINGLES).toPandas()
    h = got.h.to_numpy(SIGNED).view(np.uint64)
    by = np.argsort(h)
    return h[by], got.c.to_numpy(np.int64)[by]


def profiles(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the set of shingles), the PROFILE columns, keys, row (which row_key gives), and mark (the fingerprint as a signed long)."""
    order = spark.sparkContext.broadcast(shingle_order(spark, docs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found, keys, marks = [], [], [], []
            for text in binary(batch, "text"):
                marks.append(fingerprint(text))
                hashes = _hashes(text)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                found.append(_profile(hashes))
                keys.append(prefix(hashes[:, 0], order.value).tobytes())
            columns = np.array(found, np.uint64).reshape(-1, len(PROFILE)).astype(SIGNED).T
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests, pa.binary()), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(keys, pa.binary()), batch["row"], pa.array(np.array(marks, np.uint64).astype(SIGNED))], ["doc_id", "digest", *PROFILE, "keys", "row", "mark"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    return chosen.mapInArrow(tidy(each), "doc_id bigint, digest binary" + "".join(f", {c} bigint" for c in PROFILE) + ", keys binary, row struct<a:bigint,b:bigint>, mark bigint")


#: Rows of the index: a key, and a set of shingles with its profile.
ENTRY = ["key", "fp", *PROFILE]
#: A task compares two blocks of sets of a family at most; a block has about so many sets and bytes.
BLOCK_SETS, BLOCK_BYTES = 2048, 8 << 20
ROWS_AT_ONCE = 256


def _close(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Whether entries (columns of ENTRY, first axis) may be near copies; small sets are so by their sizes alone."""
    small, large = np.minimum(x[2], y[2]), np.maximum(x[2], y[2])
    apart = sum(np.bitwise_count((x[k] ^ y[k]).view(np.uint64)).astype(np.int16) for k in (3, 4))
    return (5 * small >= 4 * large) & ((apart <= bits) | (small < SMALL_SET))


def _trees(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the close ones among rows, by breadth-first search in blocks: places a, b of its links, and the tree of each row."""
    root = np.full(rows.shape[1], -1)
    a, b = [np.array([], np.int64)], [np.array([], np.int64)]
    for start in range(rows.shape[1]):
        if root[start] >= 0:
            continue
        root[start] = start
        frontier = np.array([start])
        while len(frontier):
            new = []
            for at in range(0, len(frontier), 256):
                some, rest = frontier[at : at + 256], np.flatnonzero(root < 0)
                if not len(rest):
                    break
                near = _close(rows[:, some, None], rows[:, None, rest], bits)
                hit = near.any(0)
                root[rest[hit]] = start
                a.append(rest[hit])
                b.append(some[near[:, hit].argmax(0)])
                new.append(rest[hit])
            frontier = np.concatenate(new) if new else np.array([], np.int64)
    return np.concatenate(a), np.concatenate(b), root


def _middle(rows: np.ndarray) -> int:
    """The entry whose fingerprint is nearest to the majority of all: of a family of copies most likely the one they come from."""
    words = np.ascontiguousarray(rows[3:5].T).view(np.uint64)
    return int(np.bitwise_count(words ^ _majority(words)).sum(1).argmin())


def _candidates(entries: DataFrame, posting: int | None) -> DataFrame:
    """Candidate links of the entries that share a key: ENTRY columns, of which fp is one end, b the other, and forest.

    A posting of up to CROWD members sends all candidates. A larger one sends links of its middle to all others that are close, and a
    forest that spans all that are close (forest is true), links of TIGHT_BITS first. One of over `posting` members sends its
    members, numbered in blocks of so many, with b null.
    """
    names = [*ENTRY, "b", "forest", "block"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, fp: postings one after another."""

        def linked(a: np.ndarray, b: np.ndarray, forest: bool) -> pa.RecordBatch:
            ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            n = ends.shape[1]
            empty = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([empty, pa.array(ends[0]), *[empty] * (len(ENTRY) - 2), pa.array(ends[1]), pa.array(np.full(n, forest)), empty], names)

        def crowd(rows: np.ndarray, at: int) -> pa.RecordBatch:
            n = rows.shape[1]
            block = (at + np.arange(n)) // posting
            return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in rows], pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(block)], names)

        def links_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(rows[0])) + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [rows.shape[1]]])
            size = last - first
            a, b = [np.array([], SIGNED)], [np.array([], SIGNED)]
            for z in np.unique(size[(size > 1) & (size <= CROWD)]).tolist():
                i, j = np.triu_indices(z, 1)
                alike_ = first[size == z]
                for at in range(0, len(alike_), 1000):
                    x, y = ((alike_[at : at + 1000, None] + k[None, :]).ravel() for k in (i, j))
                    near = _close(rows[:, x], rows[:, y], COPY_BITS)
                    a.append(rows[1, x[near]])
                    b.append(rows[1, y[near]])
            yield linked(np.concatenate(a), np.concatenate(b), False)
            for f, z in zip(first[size > CROWD].tolist(), size[size > CROWD].tolist(), strict=True):
                some = np.ascontiguousarray(rows[:, f : f + z])
                if posting and z > posting:
                    yield crowd(some, 0)
                else:
                    x, y, tree = _trees(some, TIGHT_BITS)
                    u, v, _ = _trees(some, COPY_BITS)
                    between = tree[u] != tree[v]
                    yield linked(some[1, np.concatenate([x, u[between]])], some[1, np.concatenate([y, v[between]])], True)
                    c = _middle(some)
                    near = np.flatnonzero(_close(some[:, [c]], some, COPY_BITS) & (np.arange(z) != c))
                    yield linked(some[1, near], np.full(len(near), some[1, c]), True)

        held, out = np.zeros((len(ENTRY), 0), SIGNED), 0  # out: members of the posting at hand that are sent already
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch[c].to_numpy() for c in ENTRY])], axis=1)
            ended = np.flatnonzero(np.diff(rows[0]))
            at, cut = 0, int(ended[-1]) + 1 if len(ended) else 0
            if out and cut:  # the rest of the large posting
                at = int(ended[0]) + 1
                yield crowd(rows[:, :at], out)
                out = 0
            if cut > at:
                yield from links_of(rows[:, at:cut])
            held = rows[:, cut:]
            if posting and held.shape[1] > 1 and (out or held.shape[1] > max(posting, CROWD)):
                yield crowd(held[:, :-1], out)
                out += held.shape[1] - 1
                held = held[:, -1:]
        if out:
            yield crowd(held, out)
        elif held.shape[1]:
            yield from links_of(held)

    schema = "".join(f"{c} bigint, " for c in ENTRY) + "b bigint, forest boolean, block bigint"
    return entries.select(*ENTRY).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(compare), schema)


def _pairs(spark: SparkSession, sets: DataFrame, posting: int | None) -> DataFrame:
    """Candidate links a, b, forest among sets (fp, PROFILE, keys); every block of a large posting meets every other."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k, SIGNED) for k in batch["keys"].to_pylist()]
            times = np.array([len(k) for k in keys], np.int64)
            if times.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[pa.array(np.repeat(batch[c].to_numpy(), times)) for c in ENTRY[1:]]], ENTRY)

    entries = sets.select("keys", *ENTRY[1:]).mapInArrow(tidy(index), ", ".join(f"{c} bigint" for c in ENTRY))
    found = materialize(spark, _candidates(entries, posting or POSTING), "copy-candidates")
    crowd, links_ = found.where("b IS NULL"), found.where("b IS NOT NULL").select(F.col("fp").alias("a"), "b", "forest")
    if not crowd.isEmpty():
        last = crowd.groupBy("key").agg(F.max("block").alias("last"))
        other = crowd.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).where("other <> block")
        cells = other.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        met = _candidates(cells, None).select(F.col("fp").alias("a"), "b", "forest")
        links_ = links_.union(met)
    return materialize(spark, links_.groupBy("a", "b").agg(F.max("forest").alias("forest")), "copy-pairs")


def marked_links(spark: SparkSession, marks: DataFrame) -> DataFrame:
    """Links a, b (a < b) among sets (mark: the fingerprint of a document of the set, fp) by links of fingerprints: the least set of each to
    that of the other, and to all others of its own."""
    marks = materialize(spark, marks, "copy-marks")
    least = materialize(spark, marks.groupBy("mark").agg(F.min("fp").alias("b"), F.count("*").alias("n")), "copy-marks-least")
    same = lookup(marks, least, "mark", "n", marks.count()).select(F.col("fp").alias("a"), "b")
    near = materialize(spark, links(spark, least.select(F.col("mark").alias("fp"))), "copy-marks-links")
    total = near.count()
    for end in ("a", "b"):
        times = near.groupBy(F.col(end).alias("mark")).agg(F.count("*").alias("n"))
        near = lookup(near, times.join(least.select("mark", F.col("b").alias(f"least_{end}")), "mark").withColumnRenamed("mark", end), end, "n", total)
    both = same.union(near.select("least_a", "least_b")).where("a <> b")
    return materialize(spark, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "copy-marked")


def copy_links(spark: SparkSession, distinct: DataFrame, docs: DataFrame, marks: DataFrame, posting: int | None = None) -> DataFrame:
    """Links a, b among distinct sets (fp, PROFILE, keys, row) that have the same components as all pairs of 0.8 and more.

    The links of fingerprints (marks: mark, fp) that hold come first; of the other candidates only those between groups that these leave
    apart are verified.

    Candidates of large postings are first a forest and the links of a middle. Families (what these links connect, held or not) in
    which that leaves several groups are then compared whole, set by set, so what is linked doesn't hang on which forest
    was taken: all that are close in a posting are in one family.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array([shingles(t).tobytes() for t in binary(batch, "text")], pa.binary())], ["fp", "shingles"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["x"], batch["y"], strict=True)
            near = [alike(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair)) for pair in both]
            yield batch.select(["a", "b", "forest"]).filter(pa.array(near, pa.bool_()))

    def verified(some: DataFrame) -> DataFrame:
        sides = [sets.select(F.col("fp").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y"))]
        whole = some.join(sides[0], "a").join(sides[1], "b").select("a", "b", "forest", "x", "y")
        return materialize(spark, whole.mapInArrow(tidy(hold), "a bigint, b bigint, forest boolean"), "copy-links")

    def apart(some: DataFrame, groups: DataFrame) -> DataFrame:
        """Those of some links (a, b) whose ends are in two groups, with the groups _a, _b."""
        for end in ("a", "b"):
            some = some.join(groups.withColumnsRenamed({"node": "_node", "root": f"_{end}"}), F.col(end) == F.col("_node"), "left").drop("_node")
        return some.where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))

    marked = marked_links(spark, marks)
    freed(spark)
    found = _pairs(spark, distinct, posting)
    freed(spark)
    both = found.select("a", "b").union(marked)
    ends = both.select(F.col("a").alias("fp")).union(both.select("b")).distinct()
    rows = distinct.select("fp", "row").join(ends, "fp", "left_semi").select("fp", F.col("row").alias("_row"))
    texts = docs.select("text", row_key().alias("row")).join(rows, F.col("row") == F.col("_row")).select("fp", "text")
    sets = materialize(spark, texts.mapInArrow(tidy(each), "fp bigint, shingles binary").dropDuplicates(["fp"]), "copy-sets")
    freed(spark)
    first = verified(marked.withColumn("forest", F.lit(False)))
    rest = apart(found, components(spark, first.select("a", "b"))).select("a", "b", "forest")
    good = first.union(verified(rest))
    freed(spark)
    failed = materialize(spark, found.where("forest").join(good.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"), "copy-failed")
    if failed.isEmpty():
        return good.select("a", "b")
    groups = materialize(spark, components(spark, good.select("a", "b")), "copy-groups")
    failed = apart(failed, groups)
    if failed.isEmpty():
        return good.select("a", "b")
    families = materialize(spark, components(spark, found.where("forest").select("a", "b")), "copy-families")
    family = lambda fp: F.coalesce("_family", fp)
    by_node = families.withColumnsRenamed({"node": "_node", "root": "_family"})
    torn = failed.join(by_node, F.col("a") == F.col("_node"), "left").select(family("a").alias("_torn")).distinct()
    members = sets.join(by_node, F.col("fp") == F.col("_node"), "left").select("fp", "shingles", family("fp").alias("family")).join(torn, F.col("family") == F.col("_torn"), "left_semi")
    members = members.join(groups, F.col("fp") == F.col("node"), "left").select("family", "fp", F.coalesce("root", "fp").alias("grp"), "shingles")
    return good.select("a", "b").union(family_links(spark, materialize(spark, members, "copy-members")))


def family_links(spark: SparkSession, members: DataFrame) -> DataFrame:
    """Links a, b that join the groups (grp) of each family (family, fp, shingles) as all pairs of 0.8 and more do.

    Members are dealt into blocks, and a task holds one block or two and counts what all their sets share; of the links it finds it
    sends a spanning forest.
    """
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("size"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("size") / BLOCK_BYTES, F.lit(1.0))).cast("int")
    dealt = members.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 OR block <> other")
    cells = cells.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "grp", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        fp, grp = table["fp"].to_numpy(), table["grp"].to_numpy()
        near = similar([np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]) & (grp[:, None] != grp[None, :])
        a, b = [np.array([], np.int64)], [np.array([], np.int64)]
        open_ = near.any(1)
        for start in np.flatnonzero(open_).tolist():
            stack = [start] if open_[start] else []
            open_[start] = False
            while stack:
                i = stack.pop()
                reached = np.flatnonzero(near[i] & open_)
                open_[reached] = False
                a.append(np.full(len(reached), i))
                b.append(reached)
                stack += reached.tolist()
        del near
        handed_back()
        return pa.table({"a": fp[np.concatenate(a)], "b": fp[np.concatenate(b)]})

    return materialize(spark, cells.groupBy("family", "lo", "hi").applyInArrow(compare, "a bigint, b bigint"), "copy-family-links")


def similar(sets: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """Whether each two of some sets have a Jaccard similarity of 0.8 or more: a product of matrices counts what they share.

    Of the numbers for each two sets only the counts are held whole; products and comparisons are taken ROWS_AT_ONCE rows at a time.
    """
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, place, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    several = times > 1  # what one set alone has is shared with none
    column = (several.cumsum() - 1)[place]
    owner, column = owner[several[place]], column[several[place]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(column, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        for row in range(0, len(sets), ROWS_AT_ONCE):
            shared[row : row + ROWS_AT_ONCE] += part[row : row + ROWS_AT_ONCE] @ part.T
    near = np.zeros(shared.shape, bool)
    for row in range(0, len(sets), ROWS_AT_ONCE):
        near[row : row + ROWS_AT_ONCE] = 9 * shared[row : row + ROWS_AT_ONCE] >= 4 * (size[row : row + ROWS_AT_ONCE, None] + size[None, :])
    return near


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest, row, root and component_id, by links of near copies (Jaccard similarity of five-word shingles of 0.8 and more)."""
    each = materialize(spark, profiles(spark, docs), "profiles")
    marks = each.select("digest", "mark").distinct()
    return grouped(spark, each, "digest", lambda distinct: copy_links(spark, distinct, docs, marks.join(distinct.select("digest", "fp"), "digest").select("mark", "fp")))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns: that with the smallest doc_id, a null one only if there is no other.

    Of rows with one doc_id and text, that with the smallest hash of the other columns stays. Columns may have any names.
    """
    first = near_copies(spark, docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    survivors = first.select(F.col("least.row").alias("_key"))
    tie = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), row_key().alias("_row"), tie.alias("_tie"))
    kept = rows.join(survivors, F.col("_row") == F.col("_key"), "left_semi")
    return kept.groupBy("_row").agg(F.min_by("_doc", "_tie").alias("_doc")).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, spread(load(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
