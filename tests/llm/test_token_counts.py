import base64
import random

import pytest
from pyspark.sql import functions as F

from keylake.llm import op5_token_counts as op5

tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = op5.defaults()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edited_trees_equal_recounts(monkeypatch, library, leaf):
    monkeypatch.setattr(op5, "LEAF", leaf)
    tool, r = op5.Counter(PATH, PATTERN), random.Random(leaf)
    for _ in range(300):
        letters = r.choice(["ab  \n'1é! ", "the cat's  \n 12", "  \n\t x", "日本a 1'll"])
        doc = op5.Document("".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 60, 300]))), tool)
        for _ in range(r.randint(1, 6)):
            n, before = len(doc.text), doc.text
            a = r.randint(0, n + 2)
            b = r.choice([a, a + 1, a + r.randint(0, 20), n])
            new = "".join(r.choice(letters) for _ in range(r.choice([0, 0, 1, 2, 9, 40])))
            doc.edit(a, b, new)
            a = min(a, n)
            assert doc.text == before[:a] + new + before[max(a, min(b, n)) :]
            assert [x for lengths, _, _ in doc.leaves for x in lengths] == [e - s for s, e in tool.cut(doc.text)]
            assert doc.tokens == len(library.encode_ordinary(doc.text))
            assert doc.sums[0] == [leaf[1:] for leaf in doc.leaves]


def test_an_edit_reads_little_of_a_long_text(library):
    tool = op5.Counter(PATH, PATTERN)
    doc = op5.Document("the quick brown fox jumps over it all. " * 5000, tool)
    whole = doc.encoded
    doc.edit(100_000, 100_004, " slow")
    assert doc.encoded - whole < 10 and doc.tokens == len(library.encode_ordinary(doc.text))


def test_long_pre_tokens(library):
    tool = op5.Counter(PATH, PATTERN)
    for text in ("ab" * 3000, "!?" * 700 + "x", "é" * 900):
        assert op5.Document(text, tool).tokens == len(library.encode_ordinary(text))


def test_counts_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op5.query(spark, sf).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(library.encode_ordinary(text))
        assert r.n_tokens_after == len(library.encode_ordinary(op5.PRIVATE.sub(op5.MASK, text))) and r.n_edits == len(op5.PRIVATE.findall(text))
        assert r.n_edits or r.n_reencoded == 0


def test_odd_rows_and_given_edits(spark, library):
    rows = [(1, None, None), (2, "", [(5, 2, "a b")]), (None, "one two three", [(4, 7, "TWO"), (0, 4, ""), (-3, 900, "")]), (3, "x y", []), (3, "x y", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, changes array<struct<start:int,end:int,new:string>>").withColumn("n_tokens", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_after) for r in op5.counted(docs, PATH, PATTERN, "changes").collect()))
    assert got == [(0, 3, 3, 0), (1, 0, 0, 0), (2, 0, 1, 2), (3, 2, 0, 2), (3, 2, 0, 2)]
    assert op5.counted(docs.limit(0), PATH, PATTERN).count() == 0
