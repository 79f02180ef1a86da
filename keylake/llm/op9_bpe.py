"""BPE encoding and decoding: speculate and verify.

The tokenizer's file gives vocabulary and merges; its rules (special tokens, NFC, white space, lower case, word pattern, byte
alphabet, word ends) are followed here. Distinct words of a batch are encoded together: greedy longest match
proposes tokens; numpy then tests every adjacent pair of tokens at once for compatibility; words with a pair that fails are
merged exactly, by rank. Two adjacent tokens are compatible if no merge across their border comes before the merges
that built them; a sequence of tokens is what exact merging gives if and only if all its adjacent pairs are compatible.

Every document is encoded in its scan's own task, and nothing is shuffled.

Defined cases: a null text is an empty one, with no tokens and an empty decoded text; a null or repeated doc_id passes
through; a text of any length is encoded whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import load, spread, tidy

#: Stands for the word end within a word's string; the file's pattern never lets it into a word.
END = "\0"
#: A letter of private use, in no class of the word pattern.
UNASSIGNED = "\ue000"
#: Words whose encoding is kept for the next documents of a task (some 450 bytes each, in every worker), how many of these stay when there
#: are more and between tasks (a worker lives on, and other stages run in it), and the longest word kept.
CACHE_WORDS, KEPT_WORDS, CACHE_LENGTH = 100_000, 30_000, 64
#: Words of up to so many letters merge by plain search for the lowest rank, longer ones by a heap.
SHORT, NEVER = 32, 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next unused one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Bpe:
    """Encoder of one tokenizer file. Tokens are numbered inside by the order of their making: letters, then merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        inner = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) and t != suffix else t
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [inner(a + b) if not a.endswith(suffix) else None for a, b in pairs]
        assert None not in made and len(set(made)) == len(made), "two merges make one token"
        made_set = set(made)
        letters = [t for t in (inner(t) for t in model["vocab"]) if t not in made_set and len(t.rstrip(END)) == 1]
        self.number = {t: i for i, t in enumerate([*letters, *made])}
        self.base = len(letters)
        n = len(self.number)
        vocab = {inner(t): i for t, i in model["vocab"].items()}
        self.ids = np.array([vocab[t] for t in self.number], np.uint32)
        self.names = [t[:-1] + suffix if t.endswith(END) else t for t in self.number]
        self.left, self.right = np.arange(n), np.arange(n)
        for r, (a, b) in enumerate(pairs):
            self.left[self.base + r], self.right[self.base + r] = self.number[inner(a)], self.number[inner(b)]
        self.shift = n.bit_length()
        keys = (self.left[self.base :] << self.shift) | self.right[self.base :]
        order = np.argsort(keys)
        self.keys, self.makes = keys[order], order + self.base
        self.merge = dict(zip(keys.tolist(), range(self.base, n), strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letter = byte_letters()
        # a token that exact merging of its own letters doesn't give back is never proposed
        self.proposed = {t: i for t, i in self.number.items() if i < self.base or self.exact(t) == [i]}
        self.reach: dict[str, int] = {}  # the longest token by its first three letters
        for t in self.proposed:
            if len(t) > 2:
                self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.cached_ids: dict[str, bytes] = {}
        self.cached_names: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii():
            return self.word.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter is lowered alone, so no final sigma
        # the pattern's library knows later Unicode versions; letters that are not assigned yet are no letters here
        if new := {ord(c): UNASSIGNED for c in set(text) if unicodedata.category(c) == "Cn"}:
            return [text[slice(*m.span())] for m in self.word.finditer(text.translate(new))]
        return self.word.findall(text)

    def spell(self, word: str) -> str:
        """A word's bytes as letters, with the word end."""
        return (word if word.isascii() and word.isprintable() else "".join(map(self.letter.__getitem__, word.encode()))) + END

    def exact(self, spelled: str) -> list[int]:
        """Merges the lowest rank first, the leftmost of equal ones."""
        marks = [*spelled[:-2], spelled[-2:]] if spelled.endswith(END) else [*spelled]
        token, get, shift = [self.number[c] for c in marks], self.merge.get, self.shift
        if len(token) <= SHORT:
            makes = [get(x << shift | y, NEVER) for x, y in pairwise(token)]
            while makes and (m := min(makes)) < NEVER:
                i = makes.index(m)
                token[i : i + 2] = [m]
                del makes[i]
                if i:
                    makes[i - 1] = get(token[i - 1] << shift | m, NEVER)
                if i < len(makes):
                    makes[i] = get(m << shift | token[i + 1], NEVER)
            return token
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        heap = [(m, i, token[i], token[i + 1]) for i in range(len(token) - 1) if (m := self.merge.get(token[i] << self.shift | token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= len(token) or token[j] != b:
                continue
            token[i], token[j] = m, -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(token) and (k := self.merge.get(token[x] << self.shift | token[y])) is not None:
                    heapq.heappush(heap, (k, x, token[x], token[y]))
        return [t for t in token if t >= 0]

    def propose(self, spelled: str) -> list[int]:
        """Greedy longest match from the left, never leaving the bare word end."""
        out, at, n, get, reach = [], 0, len(spelled), self.proposed.get, self.reach.get
        while at < n:
            for end in range(min(n, at + reach(spelled[at : at + 3], 2)), at, -1):
                if end != n - 1 and (t := get(spelled[at:end])) is not None:
                    break
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of the letters of a and b together gives a, b; for all pairs at once.

        Unmakes the later-made of the two tokens at the border, again and again. A merge across the border comes first if
        it was made before the left token's next merge, or not after the right one's (of equals the leftmost goes first).
        """
        a, b = a.copy(), b.copy()
        fine = np.ones(len(a), bool)
        left_limit = np.full(len(a), 2**62)
        right_limit = np.full(len(a), 2**62)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = (x << self.shift) | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.makes[at] < left_limit[open_]) & (self.makes[at] <= right_limit[open_])
            fine[open_[crossed]] = False
            go_left = x > y
            done = crossed | (np.where(go_left, x, y) < self.base)
            open_, x, y, go_left = open_[~done], x[~done], y[~done], go_left[~done]
            left_limit[open_[go_left]], a[open_[go_left]] = x[go_left], self.right[x[go_left]]
            right_limit[open_[~go_left]], b[open_[~go_left]] = y[~go_left], self.left[y[~go_left]]
        return fine

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of distinct words, by their inner numbers."""
        spelled = [self.spell(w) for w in words]
        found = [self.propose(s) for s in spelled]
        flat = np.array([t for f in found for t in f], np.int64)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        border = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.array([], np.int64)
        pairs, which = np.unique((flat[border] << self.shift) | flat[border + 1], return_inverse=True)
        fine = self.compatible(pairs >> self.shift, pairs & ((1 << self.shift) - 1))
        for i in np.unique(owner[border][~fine[which]]).tolist():
            found[i] = self.exact(spelled[i])
        return found

    def trimmed(self) -> None:
        """Keeps the encodings of the KEPT_WORDS words met first: frequent words come early."""
        self.cached_ids = dict(islice(self.cached_ids.items(), KEPT_WORDS))
        self.cached_names = dict(islice(self.cached_names.items(), KEPT_WORDS))

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts = []
        for text in texts:
            pieces = self.split.split(text) if self.split else [text]
            parts.append([p if i % 2 else self.words(p) for i, p in enumerate(pieces)])
        if len(self.cached_ids) > CACHE_WORDS:
            self.trimmed()
        ids, names = self.cached_ids, self.cached_names
        new = [*set().union(*(words for part in parts for words in part[::2])).difference(ids)]
        for w, tokens in zip(new, self.encode_words(new), strict=True):
            ids[w], names[w] = self.ids[tokens].astype("<u4").tobytes(), " ".join(map(self.names.__getitem__, tokens))
        out = []
        for part in parts:
            coded, named = [], []
            for i, piece in enumerate(part):
                if i % 2:
                    coded.append(np.uint32(self.special[piece]).astype("<u4").tobytes())
                    named.append(piece)
                else:
                    coded += map(ids.__getitem__, piece)
                    named += map(names.__getitem__, piece)
            out.append((b"".join(coded), " ".join(named)))
        for w in new:
            if len(w) > CACHE_LENGTH:
                del ids[w], names[w]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Bpe:
    """The worker's own encoder of a file."""
    return Bpe(path)


def encoded(docs: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, the columns to carry, n_tokens, ids (array<int>), decoded (the text that decoding gives)."""
    extra = [docs.schema[c] for c in carry]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch["_text"].to_pylist()]
            for at in range(0, max(1, len(texts)), 512):
                got = bpe.encode_batch(texts[at : at + 512])
                edges = np.concatenate([[0], np.cumsum([len(i) // 4 for i, _ in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(i for i, _ in got), "<i4")))
                some = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([some["_id"], *[some[c.name] for c in extra], pa.array([len(i) // 4 for i, _ in got], pa.int64()), ids, pa.array([d for _, d in got], pa.string())], ["doc_id", *carry, "n_tokens", "ids", "decoded"])
        bpe.trimmed()

    schema = "doc_id bigint, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in extra) + "n_tokens bigint, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *carry).mapInArrow(tidy(encode), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """A row per document: doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch["_text"].to_pylist()]
            sums: list[list] = [[], [], []]
            for at in range(0, len(texts), 512):
                for ids, decoded in bpe.encode_batch(texts[at : at + 512]):
                    for to, x in zip(sums, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.string()), pa.array(sums[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.trimmed()

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInArrow(tidy(digest), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), default_path())
