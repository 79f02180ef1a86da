import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keylake.llm import op6_mix, op7_lm, op8_langid
from keylake.llm.common import held_out


# op6 --------------------------------------------------------------------------------------------------------------------
def naive_seats(claims, seats, most):
    out = [0] * len(claims)
    for _ in range(seats):
        open_ = [i for i in range(len(claims)) if claims[i] > 0 and out[i] < most[i]]
        if not open_:
            break
        out[max(open_, key=lambda i: (claims[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_sainte_lague_is_highest_quotients():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 6)
        claims = [float(r.choice([0, r.randint(1, 9), r.random() * 100])) for _ in range(n)]
        most = [r.choice([0, 3, 1000]) for _ in range(n)]
        seats = r.randint(0, 60)
        assert op6_mix.sainte_lague(claims, seats, most) == naive_seats(claims, seats, most), (claims, seats, most)


def test_targets():
    assert op6_mix.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert op6_mix.targets([10, 1000, 10], [3, 1, 2]) == [20.0, pytest.approx(1490.0), 20.0]
    assert op6_mix.targets([], []) == [] and op6_mix.targets([0, 0], [3, 1]) == [0.0, 0.0]
    r = random.Random(4)
    for _ in range(100):
        sizes = [r.randint(0, 1000) for _ in range(r.randint(1, 8))]
        got = op6_mix.targets(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))])
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))


def corpus(spark, seed=1, n=400):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 700])), r.choice(["a", "b", "é", "a", "a", None])) for i in range(n)]
    rows += [(7, None, "b"), (None, "x y z", "a"), rows[3], rows[3], (900, " lead  and\ttrail ", "only")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_chars": F.length("text").cast("long"), "_size": F.lit("clash")})


@pytest.mark.parametrize("words", [250_000, 3_000])
def test_mix_meets_its_targets(spark, monkeypatch, words):
    monkeypatch.setattr(op6_mix, "SHARD_WORDS", words)
    docs = corpus(spark)
    got = op6_mix.mix(spark, docs).toPandas()
    again = op6_mix.mix(spark, docs.repartition(7)).toPandas()
    key = lambda x: sorted(map(str, zip(x._id, x._size, x._taken, strict=True)))
    assert key(got) == key(again)
    assert (got._taken <= 2 * got._size).all() and (got._taken >= 0).all()
    for _, g in got.fillna({"_source": "-"}).groupby("_source"):
        assert abs(g._taken.sum() - g._target.iloc[0]) <= 3 + 4 * 17, (g._taken.sum(), g._target.iloc[0])
        assert g._source_size.iloc[0] == g._size.sum()
    weights = {"a": 3, "b": 1, "only": 2, "é": 3, "-": 1}
    assert got.fillna({"_source": "-"})._source.nunique() == len(weights)


def test_the_mix_itself(spark):
    docs = corpus(spark)
    mixed = op6_mix.mixed(spark, docs)
    assert mixed.columns == docs.columns
    rows = mixed.toPandas()
    taken = op6_mix.mix(spark, docs).toPandas()
    assert rows.text.str.split().str.len().sum() == taken._taken.sum()
    assert (rows.n_chars == rows.text.str.len()).all()
    assert op6_mix.mixed(spark, docs.limit(0)).count() == 0
    assert op6_mix.mixed(spark, docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_passage():
    text = "  one\t two \n three"
    assert [op6_mix.passage(text, *s) for s in ((0, 3), (0, 1), (1, 2), (1, 3))] == [text, "one", "two", "two \n three"]


# op7 --------------------------------------------------------------------------------------------------------------------
def brute_counts(rows):
    """Texts as words, and counts of words, pairs, kept trigrams and their sums, all in training texts."""
    texts = [((t or "").encode().lower().split() + [b" "], h) for _, t, h in rows]
    c = Counter(w for t, h in texts if not h for w in t)
    pairs = Counter(p for t, h in texts if not h for p in zip([b" ", *t], t))
    trigrams = {k: n for k, n in Counter(p for t, h in texts if not h for p in zip([b" ", *t], t, t[1:])).items() if n >= 2}
    sums = Counter()
    for (a, b, _), n in trigrams.items():
        sums[a, b] += n
    return texts, c, pairs, trigrams, sums


def m(n):
    return op7_lm.SMOOTH_A * n**op7_lm.SMOOTH_B


def chances(w, v, u, counts):
    """p(w) and p(w | u v); u is None at a text's start."""
    _, c, pairs, trigrams, sums = counts
    p = base = (c[w] + 1) / (sum(c.values()) + len(c) + 1)
    if c[v]:
        p = (pairs[v, w] + m(c[v]) * p) / (c[v] + m(c[v]))
    if sums[u, v]:
        p = (trigrams.get((u, v, w), 0) + m(sums[u, v]) * p) / (sums[u, v] + m(sums[u, v]))
    return base, p


def brute_lm(rows):
    counts = brute_counts(rows)
    out = []
    for (i, _, h), (t, _) in zip(rows, counts[0], strict=True):
        both = [chances(w, v, u, counts) for u, v, w in zip([None, b" ", *t], [b" ", *t], t)]
        c = counts[1]
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), sum(c.values()), sum(math.log10(x) for x, _ in both), sum(math.log10(x) for _, x in both)))
    return out


def lm_rows(seed=1):
    r = random.Random(seed)
    words = ["The", "the", "a", "é", "É", "x1", "rare"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 9, 200]))), i % 7 == 2) for i in range(120)]
    return rows + [(500, None, False), (None, "a b", False), rows[5], rows[5], (501, "unseen words", True)]


@pytest.mark.parametrize("block,piece", [(8 << 20, 512), (2000, 3)])
def test_scores_equal_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(op7_lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(op7_lm, "LEAST_BYTES", block)
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumns({"block": F.lit("clash"), "score": F.lit(1)})
    got = sorted(map(tuple, op7_lm.scored(spark, docs).collect()), key=str)
    for g, w in zip(got, sorted(brute_lm(rows), key=str), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])
    assert len(brute_counts(rows)[3]) > 100


def test_pieces_and_blocks_do_not_change_scores(monkeypatch):
    """The walk in pieces of any size equals a walk token by token; repeated rows and very long texts too."""
    import pyarrow as pa
    import zstandard

    r = random.Random(9)
    texts = [" ".join(r.choice("abcde") for _ in range(n)) for n in (0, 1, 2, 3, 7, 30, 30, 4000)] * 2
    small = zstandard.ZstdCompressor(1)
    table = pa.table({"z": pa.array([small.compress(t.encode()) for t in texts], pa.binary()), "held_out": pa.array([i % 5 == 1 for i in range(len(texts))])})
    rows = [(i, t, i % 5 == 1) for i, t in enumerate(texts)]
    counts = brute_counts(rows)
    block = op7_lm.Block(table)
    words, pairs = block.counts(op7_lm.UNIGRAM), block.counts(op7_lm.BIGRAM)
    at, codes, _, place, states = block.trigrams(pairs)
    totals = np.bincount(place, block.trains[at], len(codes)).astype(int)
    totals[totals < 2] = 0
    sums = np.array([totals[(codes >> 32) == s].sum() for s in states])
    automaton = op7_lm.Automaton(block, int(words.sum()), int((words > 0).sum()), words, pairs, totals, sums)
    want = [math.log10(chances(w, v, u, counts)[1]) for t, _ in counts[0] for u, v, w in zip([None, b" ", *t], [b" ", *t], t)]
    for piece in (2, 5, 512, 10**6):
        monkeypatch.setattr(op7_lm, "PIECE", piece)
        assert op7_lm.walked(automaton, block) == pytest.approx(want)
    assert (automaton.fails[automaton.start + 1 :] < len(words)).all() and (automaton.fails[: automaton.start + 1] == automaton.root).all()


def test_texts_are_cut_into_words_once(spark):
    """One pass takes the texts' size, one deals them out; all rounds then read numbers."""
    passed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"a b w{i % 7}", i % 7 == 2) for i in range(50)], "doc_id long, text string, held_out boolean")
    assert op7_lm.scored(spark, docs.mapInArrow(seen, docs.schema)).count() == 50
    assert passed.value <= 100


def test_tokens_equal_a_split_of_bytes():
    import xxhash

    r = random.Random(4)
    some = bytes(range(256)), b" \t\n\x0b\x0c\r\x1c\x85\xa0ab\xc3\x00"
    for texts in [[b""], [b"", b" "], [b"a"], *[[bytes(r.choice(some[k % 2]) for _ in range(r.choice([0, 1, 5, 300]))) for _ in range(9)] for k in range(40)]]:
        want = [[*t.split(), b" "] for t in texts]
        hashes, token, length = op7_lm._tokens(texts)
        assert length.tolist() == [len(w) for w in want] and len(set(hashes.tolist())) == len({x for w in want for x in w})
        assert hashes[token].tolist() == [xxhash.xxh64_intdigest(x) for w in want for x in w]


def test_stored_block_equals_the_block_of_the_texts():
    import pyarrow as pa
    import zstandard

    texts = [b"", b"a b a", b"  b\xc3\xa9 ", b"a " * 300]
    table = pa.table({"doc_id": pa.array([1, None, -3, 1], pa.int64()), "held_out": [True, False, False, True], "z": [zstandard.compress(t) for t in texts]})
    block, stored = op7_lm.Block(table), op7_lm.Block.stored(op7_lm._store((pa.scalar(7),), table))
    assert stored.docs["doc_id"].to_pylist() == [1, None, -3, 1] and stored.docs["held_out"].to_pylist() == [True, False, False, True]
    for name in ("length", "first", "word", "pair", "trains"):
        assert getattr(block, name).tolist() == getattr(stored, name).tolist()
    assert all((block.keys[k] == stored.keys[k]).all() for k in (op7_lm.UNIGRAM, op7_lm.BIGRAM))


def test_messages_of_cut_numbers():
    import pyarrow as pa

    r = np.random.default_rng(2)
    for n in (0, 1, 5, 900):
        ends = np.unique(np.append(r.integers(1, n + 1, 5), n)) if n else np.zeros(1, np.int64)
        for top in (1, 254, 255, 256, 2**16, 2**40, 2**64 - 1):
            x = r.integers(0, top, n, np.uint64, endpoint=True)
            rows = pa.chunked_array([op7_lm._cut(x, ends), op7_lm._cut(x[:0], np.zeros(1, np.int64)), op7_lm._cut(x >> np.uint64(20), ends)])
            numbers, size = op7_lm._joined(rows)
            assert (numbers == np.concatenate([x, x >> np.uint64(20)])).all()
            assert size.tolist() == [*np.diff(ends, prepend=0), 0, *np.diff(ends, prepend=0)]
            if n:
                first, steps = op7_lm._cut_keys(np.sort(x), ends)
                assert (op7_lm._joined_keys(pa.chunked_array([first]), pa.chunked_array([steps]))[0] == np.sort(x)).all()
    assert len(op7_lm._joined(pa.chunked_array([], op7_lm.NUMBERS))[0]) == 0


def test_messages_cost_by_keys_not_by_shards():
    """A block's messages to 20,000 shards take about the time of those to 20; the larger the corpus, the more shards."""
    import time

    import pyarrow as pa
    import zstandard

    r = random.Random(5)
    text = " ".join(f"w{r.randrange(100000)}" for _ in range(200000)).encode()
    table = pa.table({"doc_id": pa.array([1]), "held_out": [False], "z": [zstandard.compress(text)]})
    (batch,) = op7_lm._store((pa.scalar(7, pa.int32()),), table).to_batches()

    def took(shards):
        start = time.process_time()
        sent = list(op7_lm._first_requests(shards)(iter([batch])))
        return time.process_time() - start, sum(x.num_rows for x in sent)

    few, many = (min(took(shards) for _ in range(3)) for shards in (20, 20000))
    assert few[1] == 40 and many[1] > 30000 and many[0] < 4 * few[0]


def test_scores_without_training_text(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    assert sorted((r.doc_id, r.n_known, r.train_tokens, r.score) for r in op7_lm.scored(spark, docs).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert op7_lm.scored(spark, docs.limit(0)).count() == 0


def test_probabilities_of_next_words_sum_to_one():
    counts = brute_counts(lm_rows())
    _, c, _, _, sums = counts
    for u, v in [*list(sums)[:10], (None, b" "), (None, b"a")]:
        assert sum(chances(w, v, u, counts)[1] for w in [*c, b"never seen"]) == pytest.approx(1)


def test_model_beats_the_base_on_held_out_text(spark, sf):
    got = op7_lm.query(spark, sf).toPandas()
    kept = got[got.held_out]
    assert len(kept) and kept.score.sum() > kept.base_score.sum()


def test_packed_numbers():
    for top in (0, 255, 256, 2**16, 2**32, 2**40, 2**63):
        x = np.array([0, top, 1, 7], np.uint64)
        assert (op7_lm._unpacked(op7_lm._packed(x)) == x).all()
        assert (op7_lm._unpacked_keys(op7_lm._packed_keys(np.sort(x))) == np.sort(x)).all()
    for none in (np.zeros(0, np.uint64), np.zeros(0, np.int64)):
        assert len(op7_lm._unpacked(op7_lm._packed(none))) == 0
    assert op7_lm._unpacked_keys(op7_lm._packed_keys(np.array([5], np.uint64))).tolist() == [5]


def test_held_out_is_crc32(spark):
    ids = [*range(50), -3, 10**12]
    got = spark.createDataFrame([(i,) for i in ids] + [(None,)], "i long").select("i", held_out(F.col("i"), 7).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 7 == 2) for r in got)


# op8 --------------------------------------------------------------------------------------------------------------------
def test_language_accuracy(spark):
    got = op8_langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= set(got.lang)
    assert got.rejected.mean() < 0.005


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "123 _ !!", "en"), (3, "the cat and the dog", "en"), (3, "the cat and the dog", "en"), (None, "der hund und die katze", "de"), (5, "le chat et le chien" * 9000, "fr"), (6, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "_id": F.lit(2)})
    model = op8_langid.train(spark, docs)
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in op8_langid.identified(spark, docs, model).collect()))
    assert [g for g in got if g[0] != 6] == [(0, "de"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (5, "fr")]
    kept = op8_langid.filtered(spark, docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3, None, 5} and not {r.doc_id for r in kept.collect()} & {1, 2}
    nothing = op8_langid.train(spark, docs.limit(0))
    assert {r.lang_pred for r in op8_langid.identified(spark, docs, nothing).collect()} == {"und"}
    assert op8_langid.identified(spark, docs.limit(0), model).count() == 0


def test_letters():
    assert [op8_langid.letters(t) for t in ("①②", "½ ²", "Ⅷ", "_", "٣", "", None)] == [""] * 7
    assert op8_langid.letters("É1a_b²ß") == " é a b ß " and op8_langid.letters("e\u0301t") == " e\u0301t "


def test_predictions_equal_nearest_centroids_by_hand():
    """Hashed n-grams, TF-IDF, cosine, the nearest of all centroids and the limit, with dictionaries and loops."""
    r = np.random.default_rng(4)
    texts = ["the cat sat on the mat", "der hund und die katze", "le chat et le chien", "zz qq", "12", "Él niño " * 40]
    middle = op8_langid.unit(np.abs(r.standard_normal((7, op8_langid.DIM))).astype(np.float32))
    langs, idf = ["de", "de", "en", "en", "en", "fr", "fr"], r.random(op8_langid.DIM) + 0.1
    model = op8_langid.Model(langs, middle, idf, r.random((7, len(op8_langid.LENGTHS))) * 0.3)
    got = model.predict(texts)
    for text, lang, score, rejected in zip(texts, *got, strict=True):
        found = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        if not found.strip():
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        grams = Counter()
        for n in range(1, 5):
            for i in range(len(found) - n + 1):
                code = ord(found[i]) + 1
                for c in found[i + 1 : i + n]:
                    code = (code * int(op8_langid.ODD) + ord(c) + 1) % 2**64
                grams[((code + n - 1) * int(op8_langid.SPREAD)) % 2**64 >> 64 - op8_langid.DIM_BITS] += 1
        vector = {k: math.sqrt(n) * idf[k] for k, n in grams.items()}
        size = math.sqrt(sum(x * x for x in vector.values()))
        cosine = [sum(x * float(row[k]) for k, x in vector.items()) / size for row in middle]
        best = {a: max(c for c, b in zip(cosine, langs, strict=True) if b == a) for a in set(langs)}
        odds = {a: math.exp(op8_langid.SHARPNESS * (c - max(best.values()))) for a, c in best.items()}
        assert lang == max(best, key=best.get) and score == pytest.approx(max(odds.values()) / sum(odds.values()), rel=1e-3)
        step = min(max(int(math.log2(max(len(found), 16) / 16)), 0), len(op8_langid.LENGTHS) - 1)
        assert rejected == (max(cosine) < op8_langid.REJECT * model.least[int(np.argmax(cosine)), step])


def test_far_text_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op8_langid.train(spark, docs)
    _, _, rejected = model.predict(["цзкжщ яъы эюё фхц " * 40, "ξψφ θλπ ωσδ ζηκ " * 40, "漢字仮名交文 日本語処理 " * 40])
    assert rejected.all()


def test_document_frequencies_cover_all_rows(spark, monkeypatch):
    assert op8_langid.DIM == 1 << 14 and op8_langid.SAMPLE == 1000
    monkeypatch.setattr(op8_langid, "SAMPLE", 2)
    texts = ["the cat", "der hund", "le chat", "the dog", "die katze", "the end", "123", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string")
    found = [x for t in texts * 3 if (x := op8_langid.letters(t))]
    df = np.sum([op8_langid.counts(t) > 0 for t in found], axis=0)
    assert op8_langid.train(spark, docs).idf == pytest.approx(np.log((1 + len(found)) / (1 + df)) + 0.1)
