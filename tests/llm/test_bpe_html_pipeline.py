import hashlib
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keylake.llm import common, op2_quality, op4_simhash, op6_mix, op8_langid, op9_bpe, op10_html
from keylake.llm.common import held_out
from keylake.llm.queries import ORACLE_SQL, QUERIES

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return op9_bpe.Bpe(op9_bpe.default_path())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(op9_bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def agree(bpe, library, texts):
    for text, (ids, decoded), want in zip(texts, bpe.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:80]
        assert decoded == library.decode(want.ids, skip_special_tokens=False), text[:80]


def test_bpe_equals_the_library(bpe, library, spark):
    agree(bpe, library, [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()])
    agree(bpe, library, ["", "a", "'s it's I'LL we'Ve ΑΣ ΣΑΣ İstanbul ß ﬁ é é", "<|startoftext|>hi<|endoftext|> x <|endoftext|>", "a\0b\x7f", "  \x1c x \x85y", "x" * 9000, "ab" * 5000, "1234 ٣ ½ Ⅷ", "日本語 한국어 ՘\U00010940"])
    r = random.Random(1)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 14), ("aeionrt", 30), ("aa!é'日ñ-1 \0", 20)):
        agree(bpe, library, [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, n))) for _ in range(40)) for _ in range(150)])


def test_verified_words_are_those_that_merge_to_themselves(bpe):
    r = random.Random(3)
    for _ in range(2000):
        word = bpe.spell("".join(r.choice("aeinorst") for _ in range(r.randint(1, 12))))
        tokens = bpe.propose(word)
        pairs = np.array([*zip(tokens, tokens[1:])], np.int64).reshape(-1, 2)
        assert bpe.compatible(pairs[:, 0], pairs[:, 1]).all() == (tokens == bpe.exact(word))


def test_long_words_merge_alike(bpe, monkeypatch):
    words = [bpe.spell("".join(random.Random(i).choice("aeinorst") for _ in range(25))) for i in range(200)]
    plain = [bpe.exact(w) for w in words]
    monkeypatch.setattr(op9_bpe, "SHORT", 0)
    assert [bpe.exact(w) for w in words] == plain


def test_bpe_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "Hi"), (2, "Hi"), (2, "Hi")], "doc_id long, text string").withColumns({"ids": F.lit("clash"), "_id": F.lit(1)})
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_bpe.digests(docs, op9_bpe.default_path()).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert (1, 0, sha(b""), sha(b"")) in rows and len(rows) == 3
    full = op9_bpe.encoded(docs, op9_bpe.default_path()).where("doc_id = 2").first()
    assert full.n_tokens == len(full.ids) and (2, full.n_tokens, sha(np.array(full.ids, "<u4").tobytes()), sha(full.decoded.encode())) in rows
    assert op9_bpe.digests(docs.limit(0), op9_bpe.default_path()).count() == 0
    assert op9_bpe.encoded(docs.limit(0), op9_bpe.default_path()).count() == 0


# op10 -------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def forest(spark):
    return op10_html.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


TEXT = ["The river rose in the night and the lower town was cut off by noon.", "Boats were sent, and by evening all who wished to leave had been brought to the hall on the hill.", "No one was hurt, said the mayor; the bridge will be looked at when the water falls."]


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_marked_pages(forest):
    paragraphs = "".join(f"<p>{t}</p>" for t in TEXT)
    body = f'<header><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice">We use cookies here.</div><article><h1>Flood &amp; rain</h1>{paragraphs}<script>x("</p>")</script><div class="share">Share this</div></article><aside>Related: <a href=x>other</a></aside><section id="comments"><p>First! What a good story this was to read today.</p></section><form><input><button>Send</button></form><footer>&copy; us</footer>'
    assert op10_html.extract(page(body), forest) == "\n\n".join(["Flood & rain", *TEXT])


def test_unmarked_pages(forest):
    paragraphs = "".join(f"<p>{t}</p>" for t in TEXT * 3)
    body = f'<div class="nav"><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div class="c1"><div>{paragraphs}</div></div><div class="sidebar"><ul><li><a href=q>Old news</a></li></ul></div><div class="comments"><p>Nice one, thank you so much for writing all of this up.</p></div><div id="footer">All rights reserved</div>'
    got = op10_html.extract(page(body), forest)
    assert got == "\n\n".join(TEXT * 3)


def test_long_lists_of_siblings(forest):
    paragraphs = [f"{TEXT[i % 3]} That was day {i}." for i in range(300)]
    body = "".join(f"<p>{t}</p>" for t in paragraphs) + "<div>x</div>" * 20
    parsed = op10_html.parse(f"<div>{body}</div>")
    x = op10_html.features(*parsed)
    col = lambda k: x[2:, op10_html.NAMES.index(k)].tolist()
    sizes = [len(t) for t in parsed[1]]
    assert col("before_chars") == [0, *sizes[:-1]] and col("after_chars") == [*sizes[1:], 0]
    assert col("like_siblings") == [300 / 320] * 300 + [20 / 320] * 20
    unmarked = f'<div class="nav"><a href=a>One</a> <a href=b>Two</a></div><div class="c1"><div>{body[: body.index("<div>")]}</div></div><div id="footer">All rights reserved</div>'
    assert op10_html.extract(page(unmarked), forest) == "\n\n".join(paragraphs)


GOLD = [  # pages by hand, with the text that is wanted
    (f'<div id="kopf"><a href="/">Start</a></div><div class="inhalt"><h2>Hochwasser</h2><p>{TEXT[0]}</p><p>Euler: <math><mi>e</mi><mo>=</mo><mn>2.718</mn></math> holds, as <svg><title>no</title><text>drawn</text><path d="M0"/></svg> here.</p><noscript><p>{TEXT[1]}</p></noscript><object data="x"><p>{TEXT[2]}</p></object></div><div id="fuss"><a href="/impressum">Impressum</a></div>', ["Hochwasser", TEXT[0], "Euler: e=2.718 holds, as drawn here.", TEXT[1], TEXT[2]]),
    (f'<ul class="menu"><li><a href=a>Uno</a><li><a href=b>Dos</a></ul><main><h1>Crecida</h1><p>{TEXT[0]}</p><select><option>no</option></select><table><tr><td>{TEXT[1]}</td></tr></table><form><label>Correo</label><textarea>no</textarea></form></main><div role="contentinfo">Aviso legal</div>', ["Crecida", TEXT[0], TEXT[1]]),
]


@pytest.mark.parametrize("body,want", GOLD)
def test_pages_by_hand(forest, body, want):
    assert op10_html.extract(page(body), forest) == "\n\n".join(want)


def test_long_unclosed_markup_takes_time_in_proportion():
    for broken in ("<span>x " * 100_000, "<p>" + "<b>x</i>" * 100_000, "<a>y</p> " * 100_000):
        began = time.perf_counter()
        assert len(op10_html.parse(broken)[1]) >= 1
        assert time.perf_counter() - began < 20


def test_template_text_of_a_host_is_no_article():
    tree, texts, links = op10_html.parse(f"<div><p>{TEXT[0]}</p><p>{TEXT[1]}</p></div>")
    x = op10_html.features(tree, texts, links)
    assert op10_html.weak_labels(tree, x, np.array([False, False, True, False])).tolist()[2:] == [False, True]


def test_attribute_tokens_are_learned():
    odds = op10_html.token_odds([{1, 5}] * 50 + [{2, 5}] * 50, np.array([1] * 50 + [0] * 50))
    assert odds[1] > 1 > -1 > odds[2] and odds[5] == odds[9] == 0


def test_parsing():
    blocks = lambda s: op10_html.parse(s)[1]
    assert blocks("<p>a<b>b</b> c<br>d<p>e&nbsp;&eacute;&#x41; &amp &lt;p&gt;<ul><li>1<li>2</ul>f") == ["ab c d", "e éA & <p>", "1", "2", "f"]
    assert blocks("x<!-- <p>no</p> -->y<script>if(a<b)'</p>'</script>z<style>p{}</style>") == ["xy z"]
    assert blocks("a<div>b<span>c</div>d</span>e</p>f") == ["a", "bc", "de f"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert blocks("<p>cut off <b") == ["cut off"] and blocks("<p title='>'>x</p>") == ["x"] and blocks("<!-- open") == []
    assert blocks("1 < 2 and 3 <4") == ["1 < 2 and 3 <4"]


def test_decoding_keeps_no_child_of_a_dropped_element():
    nodes, texts, _ = op10_html.parse("<div>aaaa<p>bbbb</p></div><div>cccc<p>dddd</p></div>")
    tags = [n.tag for n in nodes]
    assert tags == ["#root", "div", "p", "div", "p"]
    assert op10_html.decode(nodes, texts, np.array([0, -4.0, 1, 1, -4])) == ["cccc"]
    assert op10_html.decode(nodes, texts, np.array([0, -1.0, 3, -1, -3])) == ["aaaa", "bbbb"]


def test_pages_odd_rows(spark, forest):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (None, "u", page("<article><p>" + TEXT[0] * 3 + "</p></article>")), (3, "u", deep), (3, "u", deep), (4, "u", "<p>" + "long text here. " * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in op10_html.extracted(pages, forest).collect()}
    assert got[1] == ("", 0) and got[2] == ("", 0) and got[None][0] == TEXT[0] * 3
    assert all(n == len(t) for t, n in got.values()) and got[4][1] == 16 * 40_000 - 1
    assert op10_html.extracted(pages.limit(0), forest).count() == 0
    assert op10_html.extract("<p>x</p>", op10_html.train(pages.limit(0))) in ("", "x")


def test_article_text_of_the_test_pages(spark, forest):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(50).collect():
        inner = r.html[r.html.index("<article>") :].split("</article>")[0]
        assert op10_html.extract(r.html, forest) == "\n\n".join(op10_html.parse(inner)[1])


# pipeline ---------------------------------------------------------------------------------------------------------------
def test_pipeline_equals_its_stages_by_hand(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    forest = op2_quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r, k in zip(rows, op2_quality.judged([r["text"].encode() for r in rows], forest)["kept"], strict=True) if k]
    kept = pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r["doc_id"] for r in rows)
    known = pipeline.language_id(spark, kept, sf)
    assert known.columns == docs.columns and known.count() >= 0.99 * len(rows)
    alone = pipeline.simhash_dedup(spark, known, sf)
    texts = {r.doc_id: r.text for r in known.collect()}
    left = {r.doc_id for r in alone.collect()}
    assert alone.columns == docs.columns and left <= set(texts)
    assert {texts[i] for i in left} <= set(texts.values()) and len({texts[i] for i in left}) == len(left)
    mixed = pipeline.mix_sources(spark, alone, sf)
    assert mixed.columns == docs.columns
    size = sum(len(texts[i].split()) for i in left)
    assert sum(len(r.text.split()) for r in mixed.collect()) == pytest.approx(1.5 * size, rel=0.01)
    out = pipeline.bpe_codec(spark, mixed, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixed.collect())
    assert pipeline.run(spark, sf).count() == mixed.count()


ODD = ("kept", "fp", "row", "digest", "component_id", "_doc", "_row", "_key", "_tie", "_size", "_id", "_text", "ids", "score", "rejected")


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Documents with null and empty columns, repeated rows, copies, a very long text and many names of the stages' own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND doc_id >= 300").orderBy("doc_id").limit(250).collect()]
    text, long_ = rows[next(i for i, r in enumerate(rows) if r[2] == "en" and r[4] > 2000)][1], "\n".join(more)
    words = text.split()
    near = " ".join([*words[: len(words) // 2], "edited", *words[len(words) // 2 :]])
    rows += [rows[0], rows[0], (900, None, "en", "web", 0), (901, "", None, None, None), (902, " \n", "en", None, 2), (903, text, "en", "web", len(text)), (904, near, None, None, len(near))]
    rows += [(None, more[0], "en", "web", len(more[0])), (None, more[1], None, None, None), (905, more[2], None, None, None), (906, long_, "en", "web", len(long_)), (907, "short text", "en", "web", 10)]
    made = spark.createDataFrame(rows, docs.schema).withColumns({c: F.lit(f"clash {c}") for c in ODD})
    path = tmp_path_factory.mktemp("odd")
    made.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").withColumn("text", F.lit("clash")).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_equals_brute_force_on_odd_rows(spark, odd, library):
    """Every stage against plain Python on what the one before it kept, and the rows of run() against the last."""
    import corpus_pipeline as pipeline
    from tests.llm.test_search_quality import brute_kept
    from tests.llm.test_warc_simhash import brute_copies

    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    forest = op2_quality.train(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    kept = pipeline.quality_rules(spark, docs, odd)
    assert kept.columns == docs.columns and ids(kept) == [r for r in sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()) if brute_kept(r[2], forest)[-1]]
    known = pipeline.language_id(spark, kept, odd)
    model = op8_langid.train(spark, kept.where(~held_out(F.col("doc_id"), op8_langid.FOLDS)))
    judged = ids(kept)
    assert known.columns == docs.columns and ids(known) == [r for r, no in zip(judged, model.predict([r[2] for r in judged])[2], strict=True) if not no]
    alone = pipeline.simhash_dedup(spark, known, odd)
    rows = sorted(set(ids(known)))
    group = brute_copies([(i, r[2].encode()) for i, r in enumerate(rows)])
    assert alone.columns == docs.columns and ids(alone) == [rows[i] for i in sorted(set(group.values()))]
    assert all(r[c] == f"clash {c}" for r in alone.collect() for c in ODD) and len(set(group.values())) < len(rows) - 2
    left = ids(alone)
    mixed = pipeline.mix_sources(spark, alone, odd)
    mix = mixed.collect()
    texts = {r.doc_id: r.text for r in alone.collect() if r.doc_id is not None}
    taken = {}
    for r in mix:
        whole = texts[r.doc_id] if r.doc_id is not None else next(t for null, _, t in left if null and r.text in t)
        assert r.text in whole and r.n_chars in (len(r.text), None)
        taken[r.source, whole] = taken.get((r.source, whole), 0) + len(r.text.encode().split())
    assert mixed.columns == docs.columns and all(n <= 2 * len(t.encode().split()) for (_, t), n in taken.items())
    names = sorted({r.source for r in alone.collect()}, key=lambda s: (s is None, s or ""))
    total = [sum(len(r.text.encode().split()) for r in alone.collect() if r.source == name) for name in names]
    for name, want in zip(names, op6_mix.targets(total, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))]), strict=True):
        assert abs(sum(n for (s, _), n in taken.items() if s == name) - want) <= 0.02 * want + 70
    coded = library.encode_batch([r.text for r in mix], add_special_tokens=False)
    want = sorted((r.doc_id is None, r.doc_id or 0, c.ids, library.decode(c.ids, skip_special_tokens=False)) for r, c in zip(mix, coded, strict=True))
    for got in (pipeline.bpe_codec(spark, mixed, odd), pipeline.run(spark, odd)):
        assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in got.collect()) == want


def test_pipeline_of_an_empty_table(spark, odd, tmp_path):
    import corpus_pipeline as pipeline

    for table in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [len(m.__doc__) > 200 for m in (op6_mix, op8_langid, op4_simhash)] == [True] * 3


def test_workers_hold_few_words_between_tasks(spark, bpe, library, monkeypatch):
    path, n = op9_bpe.default_path(), op9_bpe.KEPT_WORDS + 5000
    docs = spark.createDataFrame([(i, " ".join(f"w{k}q" for k in range(i, n, 8))) for i in range(8)], "doc_id long, text string").coalesce(1)
    assert op9_bpe.encoded(docs, path).agg(F.count("*")).first()[0] == 8

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(op9_bpe.encoder(path).cached_ids)])], ["n"])

    assert max(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()) <= op9_bpe.KEPT_WORDS
    # what a full cache drops is encoded again, alike
    monkeypatch.setattr(op9_bpe, "CACHE_WORDS", 30)
    monkeypatch.setattr(op9_bpe, "KEPT_WORDS", 10)
    for at in range(4):
        agree(bpe, library, ["the cat sat on the mat", *[f"the {k}th catapult's {k * at}" for k in range(60)]])
    bpe.trimmed()
    assert len(bpe.cached_ids) == len(bpe.cached_names) == 10 and list(bpe.cached_ids) == list(bpe.cached_names)


def test_stages_bound_the_bytes_of_batches(spark):
    import corpus_pipeline

    session = spark.newSession()
    docs = session.createDataFrame([(1, "a text", "en", "web")], "doc_id long, text string, lang string, source string")
    corpus_pipeline.bpe_codec(session, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "rows"])

    got = session.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text")).mapInArrow(sizes, "size long, rows long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r["size"] for r in got) < common.BATCH_BYTES + 10_000


def test_work_on_matrices_holds_little_besides_them():
    r = np.random.default_rng(5)
    rows = r.random((512, op8_langid.DIM), np.float32)
    want = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    sets = [np.unique(r.integers(0, 4000, 200).astype(np.uint64)) for _ in range(1024)]
    # before: 1 times the rows and 7.8 times the counts
    for work, most in ((lambda: op8_langid.unit(rows), 0.5 * rows.nbytes), (lambda: op4_simhash.similar(sets), 5.5 * 4 * len(sets) ** 2)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
    assert np.allclose(rows, want)
