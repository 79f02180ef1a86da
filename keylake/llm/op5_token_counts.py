"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch.

A text is cut into pre-tokens by the tokenizer's pattern; BPE never merges across them, so a text's token count is the sum
over its pre-tokens. Groups of LEAF pre-tokens are the leaves of a tree that keeps, for every subtree, its characters and
tokens. An edit replaces a span of characters. It descends to the leaves that it touches, takes in the pre-token before
(whose end may have looked at the first changed character) and re-cuts from there until a new border falls on an old one
beyond the edit; from such a border on the cut depends on unchanged text alone, so nothing further is read. The re-cut
pre-tokens are encoded, the leaves replaced and the sums above them updated.

Every document is counted in its scan's own task; nothing is shuffled and counts of pre-tokens seen are kept in the worker.

Defined cases: a null text is an empty one with count 0; edits of one document apply one after another, each to the text
that the ones before left; spans beyond the text are cut to it and a start beyond the end of a span is moved to it; a null
id passes through; repeated rows are counted one by one. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import load, spread, tidy

#: Pre-tokens of a leaf, and of all pre-tokens those whose count the worker keeps.
LEAF, CACHE, SHORT = 64, 300_000, 32
#: What the query edits: addresses and long numbers go, as a redaction stage would do it.
PRIVATE = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<!\w)\d{9,}(?!\w)|\b[0-9a-f]{40}\b")
MASK = "[removed]"


class Counter:
    """Token counts of pre-tokens by byte-level BPE ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, int] = {}

    def count(self, piece: str) -> int:
        """Tokens of one pre-token: merges the pair of the lowest rank, the leftmost of equal ones, until none is left."""
        n = self.kept.get(piece)
        if n is None:
            n = self._merge(piece.encode())
            if len(self.kept) >= CACHE:
                self.kept.clear()
            if len(piece) <= SHORT:
                self.kept[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self.kept.get, pieces))
        return [self.count(p) if n is None else n for p, n in zip(pieces, found, strict=True)] if None in found else found

    def _merge(self, raw: bytes) -> int:
        if raw in self.rank:
            return 1
        if len(raw) > 256:
            return self._merge_long(raw)
        parts, rank = [raw[i : i + 1] for i in range(len(raw))], self.rank.get
        ranks = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < 1 << 60:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], 1 << 60)
        return len(parts)

    def _merge_long(self, raw: bytes) -> int:
        """The same for a very long pre-token, with a heap of pairs."""
        import heapq

        parts: list[bytes | None] = [raw[i : i + 1] for i in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        heap = [(r, i, raw[i : i + 2]) for i in range(len(raw) - 1) if (r := self.rank.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        left = len(parts)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            left -= 1
            if after[i] < len(parts):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := self.rank.get(pair := parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, pair))
        return left

    def cut(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """Pre-tokens (start, end) from a border on."""
        for m in self.pattern.finditer(text, start):
            yield m.span()


class Document:
    """A text with its tree. Leaves hold lengths of pre-tokens; sums[k] are (characters, tokens) of pairs of level k - 1."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        self.leaves = self._grouped(counter.pattern.findall(text))
        self._build()

    def _grouped(self, pieces: list[str]) -> list[tuple[list[int], int, int]]:
        """Leaves (lengths, characters, tokens) of consecutive pre-tokens."""
        lengths, tokens = list(map(len, pieces)), self.counter.counts(pieces)
        self.encoded += len(pieces)
        return [(some, sum(some), sum(tokens[i : i + LEAF])) for i in range(0, len(pieces), LEAF) for some in (lengths[i : i + LEAF],)]

    def _build(self) -> None:
        self.sums = [[(c, t) for _, c, t in self.leaves]]
        while len(self.sums[-1]) > 1:
            level = self.sums[-1]
            self.sums.append([tuple(map(sum, zip(*level[i : i + 2], strict=True))) for i in range(0, len(level), 2)])

    def _renew(self, first: int) -> None:
        """Sums above the leaves from `first` on, after the number of leaves changed there."""
        self.sums[0][first:] = [(c, t) for _, c, t in self.leaves[first:]]
        k = 0
        while len(self.sums[k]) > 1:
            level, first = self.sums[k], first // 2
            if k + 1 == len(self.sums):
                self.sums.append([])
            self.sums[k + 1][first:] = [tuple(map(sum, zip(*level[i : i + 2], strict=True))) for i in range(2 * first, len(level), 2)]
            k += 1
        del self.sums[k + 1 :]

    def _touch(self, leaf: int) -> None:
        """Sums above one leaf."""
        self.sums[0][leaf] = self.leaves[leaf][1:]
        for k in range(1, len(self.sums)):
            leaf //= 2
            self.sums[k][leaf] = tuple(map(sum, zip(*self.sums[k - 1][2 * leaf : 2 * leaf + 2], strict=True)))

    @property
    def tokens(self) -> int:
        return self.sums[-1][0][1] if self.leaves else 0

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, by descent, and the leaf's first character."""
        i, start = 0, 0
        for level in reversed(self.sums[:-1]):
            i *= 2
            if i + 1 < len(level) and place >= start + level[i][0]:
                start += level[i][0]
                i += 1
        return i, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end)."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        self.text = self.text[:start] + new + self.text[end:]
        if not self.leaves:
            self.__init__(self.text, self.counter)
            return
        grown = len(new) - (end - start)
        first, at = self.leaf_at(max(start - 1, 0))
        # two pre-tokens back: one ends at or just before the change, and the cut of its neighbour may have looked ahead
        lead, kept = at, []
        for n in self.leaves[first][0]:
            if lead + n >= start:
                break
            kept.append(n)
            lead += n
        if not kept and first:
            first -= 1
            at -= self.leaves[first][1]
            kept, lead = list(self.leaves[first][0]), at + self.leaves[first][1]
        if kept:
            lead -= kept.pop()
        # old borders from there on, as places in the new text, one leaf after another
        last, old = first, at
        borders: list[int] = []
        fresh: list[int] = []
        cuts = self.counter.cut(self.text, lead)
        done = lead
        while True:
            span = next(cuts, None)
            if span is None:
                last, rest = len(self.leaves), []
                break
            fresh.append(span[1] - span[0])
            done = span[1]
            if done < start + len(new):
                continue
            while last < len(self.leaves) and (not borders or borders[-1] < done):
                for n in self.leaves[last][0]:
                    old += n
                    borders.append(old + grown)
                last += 1
            if done in borders and done - grown >= end:
                ends = self.leaves[last - 1][0]
                over = len(borders) - 1 - borders.index(done)
                rest = ends[len(ends) - over :] if over else []
                break
        pieces, before = [], self.encoded
        for n in (*kept, *fresh, *rest):
            pieces.append(self.text[at : at + n])
            at += n
        leaves = self._grouped(pieces)
        self.encoded = before + len(fresh)
        if len(leaves) == last - first == 1:
            self.leaves[first] = leaves[0]
            self._touch(first)
        else:
            self.leaves[first:last] = leaves
            self._renew(min(first, max(len(self.leaves) - 1, 0))) if self.leaves else self._build()


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """The worker's own counter of a file."""
    return Counter(path, pattern)


def private_spans(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask addresses and long numbers, each against the text that the ones before left."""
    out, grown = [], 0
    for m in PRIVATE.finditer(text):
        out.append((m.start() + grown, m.end() + grown, MASK))
        grown += len(MASK) - (m.end() - m.start())
    return out


def counted(docs: DataFrame, path: str, pattern: str, edits: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens, n_reencoded.

    edits: a column of array<struct<start:int, end:int, new:string>>; without it private data is masked.
    """
    column = F.col(edits) if edits else F.lit(None).cast("array<struct<start:int,end:int,new:string>>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path, pattern)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for text, own in zip(batch["_text"].to_pylist(), batch["_edits"].to_pylist(), strict=True):
                doc = Document(text or "", tool)
                whole, pieces = doc.tokens, doc.encoded
                todo = [(e["start"], e["end"], e["new"]) for e in own or []] if edits else private_spans(text or "")
                for e in todo:
                    doc.edit(*e)
                for to, x in zip(rows, (whole, len(todo), doc.tokens, pieces, doc.encoded - pieces), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch["_id"], *[pa.array(r, pa.int64()) for r in rows]], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), column.alias("_edits"))
    return chosen.mapInArrow(tidy(count), "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_pretokens bigint, n_reencoded bigint")


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after private data is masked."""
    return counted(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), *defaults())
