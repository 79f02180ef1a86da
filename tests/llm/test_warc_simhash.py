import gzip
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keylake.llm import op3_warc, op4_simhash
from keylake.llm.common import lookup, shared_dir
from keylake.llm.components import components


# op3 --------------------------------------------------------------------------------------------------------------------
PAGE = "<p>" + "x" * 120 + "é</p>"


def warc(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = op3_warc.write(spark, op3_warc.planned(spark, pages), f"file://{tmp_path}/warc")
    return pages, index


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a/?q=\r\nx", PAGE), (1, None, PAGE), (2, "http://b", None), (4, "http://c", "short"), (5, "http://d", "short"), (6, "http://e", PAGE + "y"), (1, None, PAGE), (None, "http://n", PAGE)]
    _, index = warc(spark, rows, tmp_path)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in op3_warc.read(spark, index, payloads=True).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = html == PAGE and page != 1
        want.append((page or 0, "revisit" if revisit else "response", 1 if revisit else None, len(raw), hashlib.sha256(raw).hexdigest(), b"" if revisit else raw))
    assert got == sorted(want, key=str)


def test_index_offsets_and_selection(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7 * 50)) for i in range(60)]
    _, index = warc(spark, rows, tmp_path)
    some = index.where("page_id % 9 = 4")
    assert sorted(r.page_id for r in op3_warc.read(spark, some).collect()) == [4, 13, 22, 31, 40, 49, 58]
    one = index.where("page_id = 31").first()
    data = open(one.file.removeprefix("file://"), "rb").read()[one.offset : one.offset + one.length]
    record = gzip.decompress(data)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and record.endswith(b"\r\n\r\n") and rows[31][2].encode() in record
    whole = gzip.decompress(open(one.file.removeprefix("file://"), "rb").read())
    assert whole.count(b"WARC/1.1\r\n") == index.where(F.col("file") == one.file).count()


def test_a_read_is_dealt_out_by_bytes(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"http://h/{i}", "".join(r.choice("abcdefghij ") for _ in range(9000))) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).withColumns({"file": F.lit("clash"), "offset": F.lit(1)})
    index = op3_warc.write(spark, op3_warc.planned(spark, pages), f"file://{tmp_path}/warc")
    got = op3_warc.read(spark, index).withColumn("task", F.spark_partition_id())
    assert got.groupBy("task").count().count() > 1 and got.count() == 400


def test_ranges_coalesce():
    near = [(0, 10), (10, 5), (20, 5), (20 + op3_warc.GAP_BYTES + 6, 4), (op3_warc.READ_BYTES * 2, op3_warc.READ_BYTES + 1)]
    got = list(op3_warc.ranges(near))
    assert [(a, b, len(h)) for a, b, h in got] == [(0, 25, 3), (near[3][0], near[3][0] + 4, 1), (near[4][0], sum(near[4]), 1)]
    assert list(op3_warc.ranges([])) == []


def test_no_pages(spark, tmp_path):
    _, index = warc(spark, [], tmp_path)
    assert op3_warc.read(spark, index).count() == 0


# op4 --------------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= distance and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_fingerprints():
    for text in (None, "", " \n", "One", "a B c", "a b c d e f g a b c d e", "É é É é\x0bx y z", "w " * 70_000):
        assert op4_simhash.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text), text


def flipped(r, base, most):
    for b in r.sample(range(64), r.randint(0, most)):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("posting", [4096, 3])
def test_links_give_the_components_of_all_pairs(spark, posting):
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({flipped(r, s, 7) for s in seeds for _ in range(14)} | {0, 1, 2**64 - 1, 2**63})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = op4_simhash.links(spark, spark.createDataFrame([(f,) for f in signed], "fp long"), posting=posting)
    got = {r.node: r.root for r in components(spark, found).collect()}
    want = brute_components(fps)
    groups = {}
    for f, s in zip(fps, signed, strict=True):
        groups.setdefault(want[f], set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (5, 4)], "a long, b long")
    got = {r.node: r.root for r in components(spark, links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    assert components(spark, links.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark, tmp_path):
    long_ = " ".join(f"w{i}" for i in range(3000))
    rows = [(9, None), (3, ""), (None, " "), (5, long_), (4, long_.upper()), (None, "only null one here now"), (8, "z"), (8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "root": F.lit(1)})
    got = sorted(((r.doc_id, r.component_id) for r in op4_simhash.near_duplicates(spark, docs).collect()), key=str)
    assert got == sorted([(9, 3), (3, 3), (None, 3), (5, 4), (4, 4), (None, None), (8, 8), (8, 8)], key=str)
    kept = op4_simhash.deduplicated(spark, docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0 for r in kept.collect())) == [0, 3, 4, 8]  # null, empty and blank texts are one group
    assert op4_simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_lookup_with_heavy_keys(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(3000)] + [(-1, None)], "id long, k long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k IS NOT NULL")
    got = {r.id: r.least for r in lookup(left, right, "k", "n", 3001).collect()}
    assert got == {**{i: 1 if i % 3 else i for i in range(3000)}, -1: None}


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == shared_dir(spark) and "://" in shared_dir(spark)


# near copies ------------------------------------------------------------------------------------------------------------
def copies(r, text, share):
    words = text.split()
    for i in r.sample(range(len(words)), int(share * len(words))):
        words[i] = f"edit{r.random()}"
    return " ".join(words)


def similarity(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("posting", [4096, 4])
def test_near_copies_are_found_and_others_left(spark, monkeypatch, posting):
    monkeypatch.setattr(op4_simhash, "POSTING", posting)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    originals = [" ".join(r.choice(vocabulary) for _ in range(r.randint(80, 600))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(originals)]
    near = {}
    for i, t in enumerate(originals[:25]):
        for k in range(3):
            copy = copies(r, t, 0.012)
            near[100 + 3 * i + k] = (i, similarity(t, copy))
            rows.append((100 + 3 * i + k, copy))
    rows += [(500 + i, t.upper()) for i, t in enumerate(originals[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"w0": F.lit("clash"), "n": F.lit(1)})
    groups = {x.doc_id: x.component_id for x in op4_simhash.near_copies(spark, docs).collect()}
    close = [(i, c) for c, (i, s) in near.items() if s >= 0.8]
    assert len(close) > 50 and sum(groups[c] == i for i, c in close) >= 0.97 * len(close)
    assert all(groups[i] == i for i in range(40)) and all(groups[500 + i] == i for i in range(5))
    kept = op4_simhash.deduplicated(spark, docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} >= set(range(40))


def test_profiles():
    assert op4_simhash.profile(None) == op4_simhash.profile(b" \n") and not any(op4_simhash.profile(None)[1])
    assert op4_simhash.profile(b"One two") == op4_simhash.profile(b"one TWO\n")
    long_ = b"a b c d e f g h " * 50_000
    assert op4_simhash.profile(long_)[1][1:] == op4_simhash.profile(long_[:64])[1][1:]  # repeats count once


def test_tally_of_shared_bytes():
    r = random.Random(3)
    x = np.array([r.getrandbits(64) for _ in range(500)], np.uint64)
    y = x ^ np.array([sum((r.getrandbits(8) if r.random() < 0.4 else 0) << 8 * k for k in range(8)) for _ in range(500)], np.uint64)
    want = [sum((int(a) >> 8 * k & 255) == (int(b) >> 8 * k & 255) for k in range(8)) for a, b in zip(x, y, strict=True)]
    assert op4_simhash.shared_bytes(x ^ y).tolist() == want and set(want) > {1, 4, 8}
    near = [w >= 4 and (int(a) ^ int(b)).bit_count() <= 4 for a, b, w in zip(x, y, want, strict=True)]
    assert op4_simhash._near(x, y).tolist() == near and near == [(int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(x, y, strict=True)]


def test_the_query_equals_brute_force_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    root = brute_components(sorted(set(fps.values())))
    least = {}
    for i in sorted(fps, reverse=True):
        least[root[fps[i]]] = i
    want = sorted((i, f"{f:016x}", least[root[f]]) for i, f in fps.items())
    assert sorted(map(tuple, op4_simhash.query(spark, sf).collect())) == want


def family(r, words, size, edits):
    """A text and copies of it, each with some words replaced in places of its own."""
    base = [f"v{r.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for i in range(size):
        copy = list(base)
        for at in r.sample(range(4, words - 4), edits):
            copy[at] = f"own{i}x{at}"
        out.append(" ".join(copy))
    return out


def brute_copies(rows):
    """The least id of each document's group, by the similarity of all pairs."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = {i: [j for j in sets if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in sets}
    group = {}
    for i in sorted(sets):
        open_ = [i]
        while open_:
            if (at := open_.pop()) not in group:
                group[at] = i
                open_ += near[at]
    return group


def test_a_family_far_larger_than_a_posting_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(op4_simhash, "POSTING", 32)
    texts = family(random.Random(11), 500, 400, 10)  # near the base, far from each other
    assert similarity(texts[0], texts[1]) >= 0.8 > 0.75 > similarity(texts[1], texts[2])
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    want = brute_copies(rows)
    assert set(want.values()) == {600}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        assert {x.doc_id: x.component_id for x in op4_simhash.near_copies(spark, docs.repartition(parts)).collect()} == want
    assert [x.doc_id for x in op4_simhash.deduplicated(spark, docs).collect()] == [600]


def test_sets_compared_by_products():
    r = np.random.default_rng(6)
    base = r.choice(10**6, 60, replace=False)
    sets = [np.unique(np.concatenate([r.choice(base, k, replace=False), r.integers(0, 10**6, 3)])).astype(np.uint64) for k in r.integers(40, 61, 50)] + [np.zeros(0, np.uint64)]
    want = [[9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for b in sets] for a in sets]
    for columns in (7, 2048):
        assert op4_simhash.similar(sets, columns).tolist() == want
    assert np.sum(want) > 60 and not np.all(want) and op4_simhash.similar([]).shape == (0, 0)


def test_torn_families_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(op4_simhash, "BLOCK_SETS", 20)
    r = random.Random(17)
    texts = family(r, 300, 60, 8)[1:]  # each far from the others, but for copies of the copies
    texts += [" ".join([*t.split()[:-1], "z"]) for t in texts[::3]]
    rows = list(enumerate(texts))
    want = brute_copies(rows)
    assert 30 < len(set(want.values())) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in op4_simhash.near_copies(spark, docs).collect()} == want


def test_similar_texts_below_the_limit_stay(spark):
    r = random.Random(13)
    rows = [(100 * k + i, t) for k in range(4) for i, t in enumerate(family(r, 400, 8, 7)[1:])]  # about 0.7 to each other
    rows += [(1000 + 10 * k + i, t) for k in range(10) for i, t in enumerate(family(r, 200, 2, 3 + k % 3))]
    want = brute_copies(rows)
    assert len({want[i] for i, _ in rows[:32]}) == 32 and len(set(want.values())) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in op4_simhash.near_copies(spark, docs).collect()} == want


def test_near_copies_come_through_the_index_of_fingerprints(spark, monkeypatch):
    """With no candidates but the links of fingerprints: those within four bits that the sets confirm are groups."""
    r = random.Random(23)
    rows = [(100 * k + i, t) for k in range(6) for i, t in enumerate(family(r, 600, 3, 1 + k))]
    spam = ["buy this now and save"] * 400
    rows += [(1000 + i, " ".join(spam + [f"own{i}x{k}" for k in range(60)])) for i in range(2)]  # equal but for few words, sets far apart
    rows += [(2000 + i, t) for i, t in enumerate(["One two", "one  two", "ONE TWO three"])]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    texts = dict(rows)
    near = {(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4}
    assert (1000, 1001) in near and similarity(texts[1000], texts[1001]) < 0.2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {x.doc_id: x.component_id for x in op4_simhash.near_copies(spark, docs).collect()}
    monkeypatch.setattr(op4_simhash, "_pairs", lambda spark, *_: spark.createDataFrame([], "a long, b long, forest boolean"))
    got = {x.doc_id: x.component_id for x in op4_simhash.near_copies(spark, docs).collect()}
    joined = {(i, j) for i, j in near if got[i] == got[j]}
    assert all(whole[i] == whole[j] for i in got for j in got if got[i] == got[j])
    assert len({i // 100 for i, j in joined if j < 600}) >= 3 and joined >= {(i, j) for i, j in near if i < 600 and j == i + 1 and i % 100 == 0}
    assert got[1000] != got[1001] and got[2001] == 2000 and got[2002] == 2002
