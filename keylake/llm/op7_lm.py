"""Language-model scoring: a weighted backoff automaton over smoothed n-grams of up to three words.

States are the root, one per word (and the text's start) and one per pair of words that some kept trigram follows. An arc (s, w)
has the log-probability of w after s and leads to the longest state that ends in w; a failure arc (s -> s without its first
word) has the weight left to words that s has no arc for. The root has an arc for every word, known or not. One traversal from
left to right carries the state: it takes the arc of the next word, or failure arcs until there is one, and adds up
weights. Texts of a block are walked side by side in pieces; a piece that starts within a text first walks the two words
before it, which give its state whatever came earlier.

Probabilities: p(w) is the add-one unigram of the base score. p(w | v) = (c(v w) + m p(w)) / (c(v) + m), and p(w | u v) =
(c(u v w) + m p(w | v)) / (k(u v) + m), where trigrams seen once are left out, k sums those kept over all w, and m = SMOOTH_A *
count ** SMOOTH_B stands for the number of words that may still follow. Each sums to 1 over known words and one unknown.

The automaton of a corpus fits no machine, so it is never gathered. Texts are dealt into blocks of about BLOCK_BYTES, which are
walked in a task each: their words are numbered once and written as numbers, a row a block, which all rounds read. In a first
round a block sends each distinct word and pair of its texts once, with its count in training texts, to the key's shard, which
adds counts up over all blocks and answers each block, in the order of its keys, with totals. In a second round it asks the same
way for the trigrams of which both pairs occur twice or more (no other can be kept) and for k. The block then holds just the part
of the automaton that its own texts can reach. A frequent word is one entry a block like any other, so no key is hot, and rows are
dealt by place as well as by content, so that repeated rows spread. Counts are over all training texts; words are known by 64 bits
of hash, pairs by 56, and followers of a pair by 32 each.

Defined cases: a null text is an empty one, a single end token; a null doc_id is not held out and trains; documents
repeated in the table train and are scored one by one; without training text every token has the base's equal
probability; very long texts are one row of their block. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import binary, bounded_batches, freed, held_out, load, materialize, parallelism, tidy

FOLDS, SMOOTH_A, SMOOTH_B = 7, 2.0, 0.9
#: Trigrams with fewer occurrences have no arc.
LEAST = 2
#: Text bytes of a block, and least ones; a shard takes about as many keys as a block sends.
BLOCK_BYTES, LEAST_BYTES = 8 << 20, 256 << 10
#: Tokens that are walked before a text's next piece begins.
PIECE = 512
END = b" "  # no word can be it
START = np.uint64(xxhash.xxh64_intdigest(b"  "))
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
UNIGRAM, BIGRAM, TRIGRAM = 1, 2, 3
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """56-bit keys of pairs of word hashes."""
    x = (h * ODD) ^ (w + (h >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(29))) >> np.uint64(8)


# numbers in messages ----------------------------------------------------------------------------------------------------


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold the largest; byte planes one after another, compressed."""
    width = next(w for w in WIDTHS if w == 8 or int(numbers.max(initial=0)) < 1 << 8 * w)
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(planes)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys: the first, and the steps to the next."""
    return keys[:1].astype("<u8").tobytes() + _packed(np.diff(keys))


def _unpacked_keys(data: bytes) -> np.ndarray:
    first, steps = np.frombuffer(data[:8], "<u8"), _unpacked(data[8:])
    return np.concatenate([first, first + np.cumsum(steps, dtype=np.uint64)])


NUMBERS = pa.struct([("width", pa.int32()), ("low", pa.binary()), ("rest", pa.binary())])
NUMBERS_SQL = "struct<width: int, low: binary, rest: binary>"


def _top(width: int) -> np.uint64:
    return np.uint64((1 << 8 * width) - 1)


def _cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def _cut(numbers: np.ndarray, ends: np.ndarray) -> pa.StructArray:
    """Numbers cut at the ends, a row of NUMBERS for each stretch; no step is made for each row, as there are many short ones in a large corpus.

    low has so many bytes of each number; those that don't fit are all ones there, and whole in rest.
    """
    x = numbers.astype("<u8")
    width = min(WIDTHS, key=lambda w: w * len(x) + 8 * int(np.count_nonzero(x >= _top(w))))
    large = np.flatnonzero(x >= _top(width))
    low = np.minimum(x, _top(width)).view(np.uint8).reshape(-1, 8)[:, :width]
    parts = [pa.array(np.full(len(ends), width, np.int32)), _cells(low, ends * width), _cells(x[large], np.searchsorted(large, ends) * 8)]
    return pa.StructArray.from_arrays(parts, fields=list(NUMBERS))


def _body(cells: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows."""
    parts = []
    for c in cells.cast(pa.large_binary()).chunks:
        if len(c):
            bounds = np.frombuffer(c.buffers()[1], np.int64)
            parts.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[bounds[c.offset] : bounds[c.offset + len(c)]])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of NUMBERS, and how many each row has."""
    width, low, rest = (pc.struct_field(column, name) for name in ("width", "low", "rest"))
    width = width.to_numpy().astype(np.int64)
    size = pc.binary_length(low).to_numpy().astype(np.int64) // np.maximum(width, 1)
    own = np.repeat(width.astype(np.int8), size)
    out, large = np.zeros(len(own), np.uint64), np.zeros(len(own), bool)
    for w in np.unique(width).tolist():
        mine = own == w
        wide = np.zeros((int(np.count_nonzero(mine)), 8), np.uint8)
        wide[:, :w] = _body(low.filter(pa.array(width == w))).reshape(-1, w)
        part = wide.view("<u8").ravel()
        out[mine], large[mine] = part, part == _top(w)
    out[large] = _body(rest).view("<u8")
    return out, size


def _cut_keys(keys: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.StructArray]:
    """Rising keys, cut: the first of each stretch, and the steps from one to the next."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    steps = np.diff(keys, prepend=keys[:1])
    steps[starts] = 0
    return pa.array(keys[starts].view(np.int64)), _cut(steps, ends)


def _joined_keys(first: pa.ChunkedArray, steps: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all rows, none of which is empty, and how many each row has."""
    keys, size = _joined(steps)
    keys = keys.cumsum(dtype=np.uint64)
    return keys + np.repeat(first.to_numpy().view(np.uint64) - keys[size.cumsum() - size], size), size


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in order, where one of each is, and the place of each of x among them."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(x), np.int64)
    place[order] = new.cumsum() - 1
    return ranked[new], order[new], place


# blocks -----------------------------------------------------------------------------------------------------------------


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, all tokens as places in these, and the number of tokens of each text."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    column = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(starts), pa.py_buffer(b"".join(texts)))
    cut = pc.ascii_split_whitespace(column)  # looks at bytes alone; empty words before and after white space
    coded = cut.flatten().dictionary_encode()
    bounds = np.zeros(len(coded.dictionary) + 1, np.int64)
    np.cumsum(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False), out=bounds[1:])
    spelled, bounds = (coded.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), bounds.tolist()
    hashes = [xxhash.xxh64_intdigest(spelled[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    end = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    if end < 0:
        end = len(hashes)
        hashes.append(0)
    hashes[end] = xxhash.xxh64_intdigest(END)  # empty words are dropped, so their place is free
    word = coded.indices.to_numpy(zero_copy_only=False)
    full = word != end
    length = np.diff(np.concatenate([[0], full.cumsum()])[cut.offsets.to_numpy()]) + 1
    token = np.full(int(length.sum()), end, np.int64)
    inner = np.ones(len(token), bool)
    inner[length.cumsum() - 1] = False
    token[inner] = word[full]
    return np.array(hashes, np.uint64), token, length


def _numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens in order, all tokens as places in these, and the number of tokens of each text."""
    plain = zstandard.ZstdDecompressor()
    hashes, token, length = _tokens([plain.decompress(z) for z in table["z"].to_pylist()])
    order = np.argsort(hashes)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.arange(len(hashes))
    return hashes[order], place[token], length


class Block:
    """Tokens of a block's texts, in row order, and their distinct keys in key order.

    word and pair are the places of each token, and of each token with the one before it, in keys; texts' starts are a word of
    their own in pairs. first has the place of each text's first token.
    """

    def __init__(self, table: pa.Table):
        """table has z, a compressed lower-case text a row, and held_out."""
        self._fill(*_numbered(table), table["held_out"])

    @classmethod
    def stored(cls, table: pa.Table) -> Block:
        """The block of a row that _store wrote; docs has its documents' columns."""
        (row,) = table.to_pylist()
        block = cls.__new__(cls)
        block.docs = pa.ipc.open_stream(row["docs"]).read_all()
        block._fill(_unpacked_keys(row["hashes"]), _unpacked(row["tokens"]).astype(np.int64), block.docs["length"].to_numpy(), block.docs["held_out"])
        return block

    def _fill(self, hashes: np.ndarray, word: np.ndarray, length: np.ndarray, out: pa.ChunkedArray) -> None:
        self.length, self.word, self.keys = length, word, {UNIGRAM: hashes}
        self.first = np.concatenate([[0], length.cumsum()[:-1]]).astype(np.int64)[: len(length)]
        own = hashes[word]
        before = np.roll(own, 1)
        before[self.first] = START
        self.keys[BIGRAM], _, self.pair = distinct(pair_keys(before, own))
        self.trains = np.repeat(~out.to_numpy(zero_copy_only=False).astype(bool), length)

    def counts(self, kind: int) -> np.ndarray:
        return np.bincount(self.word if kind == UNIGRAM else self.pair, self.trains, len(self.keys[kind])).astype(np.int64)

    def trigrams(self, pair_totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose trigram may be kept; the distinct codes of these (place of the pair, 32 bits of the last word's hash), a
        token that has each, and each token's place in them; and the places of all pairs that may have followers."""
        inner = np.ones(len(self.word), bool)
        inner[self.first] = False
        state = np.roll(self.pair, 1)
        follows = inner & (pair_totals[state] >= LEAST)
        at = np.flatnonzero(follows & (pair_totals[self.pair] >= LEAST))
        tail = (self.keys[UNIGRAM][self.word[at]] >> np.uint64(32)).astype(np.int64)
        codes, one, place = distinct((state[at] << 32) | tail)
        has = np.zeros(len(pair_totals), bool)
        has[state[follows]] = True
        return at, codes, at[one], place, np.flatnonzero(has)


def _shards(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Shard of each key, rising with the key."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


REQUEST = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("keys", NUMBERS), ("counts", NUMBERS), ("fans", NUMBERS), ("tails", NUMBERS)])
REQUEST_SQL = f"shard int, block int, kind int, first long, keys {NUMBERS_SQL}, counts {NUMBERS_SQL}, fans {NUMBERS_SQL}, tails {NUMBERS_SQL}"
ANSWER = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("totals", NUMBERS), ("sums", NUMBERS), ("words", pa.int64()), ("known", pa.int64())])
ANSWER_SQL = f"block int, kind int, shard int, totals {NUMBERS_SQL}, sums {NUMBERS_SQL}, words long, known long"
NONE = np.zeros(0, np.int64)


def _requests(block: int, kind: int, keys: np.ndarray, shard: np.ndarray, counts: np.ndarray, fans: np.ndarray = NONE, tails: np.ndarray = NONE) -> pa.RecordBatch:
    """A row per shard. Without fans there is a count a key; else fans has the number of counts, and of tails, of each key."""
    edge = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(edge[1:], len(keys))[: len(edge)]
    inner = fans.cumsum()[ends - 1] if len(fans) else ends
    none = np.zeros(len(ends), np.int64)
    first, steps = _cut_keys(keys, ends)
    more = [_cut(fans, ends), _cut(tails, inner)] if len(fans) else [_cut(NONE, none)] * 2
    same = [pa.array(np.full(len(ends), x, np.int32)) for x in (block, kind)]
    return pa.RecordBatch.from_arrays([pa.array(shard[ends - 1].astype(np.int32)), *same, first, steps, _cut(counts, inner), *more], schema=REQUEST)


STORED = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("tokens", pa.binary())])
STORED_SQL = "block int, docs binary, hashes binary, tokens binary"


def _store(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
    """A block's tokens as numbers, in one row, with its documents' ids, sides and lengths."""
    hashes, word, length = _numbered(docs)
    own = docs.select(["doc_id", "held_out"]).append_column("length", pa.array(length))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, own.schema) as out:
        out.write_table(own)
    return pa.Table.from_pylist([{"block": key[0].as_py(), "docs": sink.getvalue().to_pybytes(), "hashes": _packed_keys(hashes), "tokens": _packed(word)}], STORED)


def _first_requests(shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.stored(pa.Table.from_batches([batch.slice(i, 1)]))
                for kind, bits in ((UNIGRAM, 64), (BIGRAM, 56)):
                    yield _requests(batch["block"][i].as_py(), kind, block.keys[kind], _shards(block.keys[kind], bits, shards), block.counts(kind))

    return send


def _second_requests(shards: int):
    def send(key: tuple[pa.Scalar, ...], stored: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.stored(stored)
        at, codes, _, place, states = block.trigrams(_totals(answers, BIGRAM)[0])
        count = np.bincount(place, block.trains[at], len(codes)).astype(np.int64)
        fans = np.diff(np.searchsorted(codes, states + 1 << 32), prepend=0)
        keys = block.keys[BIGRAM][states]
        return pa.Table.from_batches([_requests(key[0].as_py(), TRIGRAM, keys, _shards(keys, 56, shards), count, fans, codes & 0xFFFFFFFF)], REQUEST)

    return send


def _answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Totals of a shard's keys, for each block in its own order; the first row of words has the shard's sum and number of known ones.

    Of trigrams the totals of those kept (others are 0), and as sums k of each pair.
    """
    out = []
    for kind in (UNIGRAM, BIGRAM, TRIGRAM):
        rows = table.filter(pc.equal(table["kind"], kind))
        if not len(rows):
            continue
        keys, n_keys = _joined_keys(rows["first"], rows["keys"])
        counts, n_counts = _joined(rows["counts"])
        words, known = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        unique, _, at = distinct(keys)
        sums, n_sums = NONE, np.zeros(len(rows), np.int64)
        if kind == TRIGRAM:
            code = (np.repeat(at, _joined(rows["fans"])[0].astype(np.int64)) << 32) | _joined(rows["tails"])[0].astype(np.int64)
            several, _, place = distinct(code)
            total = np.bincount(place, counts, len(several)).astype(np.int64)
            total[total < LEAST] = 0
            sums, n_sums = np.bincount(several >> 32, total, len(unique)).astype(np.int64)[at], n_keys
            each = total[place]
        else:
            total = np.bincount(at, counts, len(unique)).astype(np.int64)
            each = total[at]
            if kind == UNIGRAM:
                words[0], known[0] = total.sum(), (total > 0).sum()
        shard = pa.array(np.full(len(rows), key[0].as_py(), np.int32))
        parts = [rows["block"].combine_chunks(), rows["kind"].combine_chunks(), shard, _cut(each, n_counts.cumsum()), _cut(sums, n_sums.cumsum()), pa.array(words), pa.array(known)]
        out.append(pa.RecordBatch.from_arrays(parts, schema=ANSWER))
    return pa.Table.from_batches(out, ANSWER)


def _totals(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and sums of a kind, in the order of the block's keys."""
    rows = answers.filter(pc.equal(answers["kind"], kind))
    rows = rows.take(pc.sort_indices(rows["shard"]))
    return tuple(_joined(rows[c])[0].astype(np.int64) for c in ("totals", "sums"))


# the automaton ------------------------------------------------------------------------------------------------------------


def leftover(count: np.ndarray) -> np.ndarray:
    """m: how many words may still follow what was seen so often."""
    return SMOOTH_A * count.astype(float) ** SMOOTH_B


class Automaton:
    """The part of the backoff automaton that a block's texts reach.

    States: words by their places, then the start, then pairs, then the root (the last). Arcs of words and pairs lie in buckets by a
    hash of state and word; the root's are one a word.
    """

    def __init__(self, block: Block, n: int, v: int, words: np.ndarray, pairs: np.ndarray, trigrams: np.ndarray, sums: np.ndarray):
        size = self.words = len(words)
        end = int(np.searchsorted(block.keys[UNIGRAM], np.uint64(xxhash.xxh64_intdigest(END)))) if size else 0
        count = np.append(words, words[end] if size else 0)  # the start occurs as often as the end
        self.start = size
        probability = (words + 1) / (n + v + 1)
        # what each distinct pair consists of
        one = np.zeros(len(pairs), np.int64)
        one[block.pair] = np.arange(len(block.pair))
        last, before = block.word[one], np.roll(block.word, 1)
        before[block.first] = self.start
        head = before[one]
        m = leftover(count)
        follows = (pairs + m[head] * probability[last]) / np.where(count[head] > 0, count[head] + m[head], 1)
        follows = np.where(count[head] > 0, follows, probability[last])
        # pair states: those with kept trigrams
        _, _, token, _, followed = block.trigrams(pairs)
        states = followed[sums > 0]
        kept = sums[sums > 0]
        self.root = size + 1 + len(states)
        state_of = np.full(len(pairs), -1)
        state_of[states] = size + 1 + np.arange(len(states))
        to = np.where(state_of >= 0, state_of, last)
        # arcs of words
        some = np.flatnonzero(pairs > 0)
        arcs = [(head[some] * size + last[some], np.log10(follows[some]), to[some])]
        # arcs of pairs
        live = trigrams > 0
        token, c = token[live], trigrams[live]
        own = state_of[np.roll(block.pair, 1)[token]]
        k = kept[own - size - 1]
        w = leftover(k)
        arcs.append((own * size + block.word[token], np.log10((c + w * follows[block.pair[token]]) / (k + w)), to[block.pair[token]]))
        codes, weights, targets = (np.concatenate(x) for x in zip(*arcs, strict=True))
        self.shift = np.uint64(64 - max(1, len(codes).bit_length()))
        bucket = self._bucket(codes)
        order = np.argsort(bucket)
        self.codes, self.weights, self.targets = codes[order], weights[order], targets[order]
        self.starts = np.concatenate([[0], np.bincount(bucket, minlength=1 << (64 - int(self.shift))).cumsum()])
        self.root_weights = np.log10(probability)
        ratio = lambda c: np.where(c > 0, np.log10(np.maximum(leftover(c), 1e-300) / np.maximum(c + leftover(c), 1e-300)), 0.0)
        self.fail_weights = np.concatenate([ratio(count), ratio(kept)])
        self.fails = np.concatenate([np.full(size + 1, self.root), last[states]])

    def _bucket(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * ODD) >> self.shift).astype(np.int64)

    def arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each state and word; -1 for none."""
        code = state * self.words + word
        bucket = self._bucket(code)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(code), -1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            i = at[open_]
            hit = self.codes[i] == code[open_]
            out[open_[hit]] = i[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights on the way, failure arcs included."""
        state, out = state.copy(), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            s, w = state[open_], word[open_]
            root = s == self.root
            if root.any():
                at, w = open_[root], w[root]
                out[at] += self.root_weights[w]
                state[at] = w
                open_, s, w = open_[~root], s[~root], word[open_[~root]]
            arc = self.arc(s, w)
            hit = arc >= 0
            at, arc = open_[hit], arc[hit]
            out[at] += self.weights[arc]
            state[at] = self.targets[arc]
            open_ = open_[~hit]
            s = state[open_]
            out[open_] += self.fail_weights[s]
            state[open_] = self.fails[s]
        return state, out


def walked(automaton: Automaton, block: Block) -> np.ndarray:
    """Weight of each token, by pieces of the texts side by side."""
    parts = -(-block.length // PIECE)
    text = np.repeat(np.arange(len(block.length)), parts)
    number = np.arange(len(text)) - np.repeat(parts.cumsum() - parts, parts)
    start = block.first[text] + number * PIECE
    size = np.minimum(PIECE, block.length[text] - number * PIECE)
    order = np.argsort(-size, kind="stable")
    start, size, inner = start[order], size[order], number[order] > 0
    out = np.zeros(len(block.word))
    state = np.where(inner, automaton.root, automaton.start)
    for back in (2, 1):
        state[inner], _ = automaton.step(state[inner], block.word[start[inner] - back])
    for t in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-size, -t, side="left"))  # pieces are sorted by size, longest first
        here = start[:active] + t
        state[:active], out[here] = automaton.step(state[:active], block.word[here])
    return out


def _scorer(n: int, v: int):
    def score(key: tuple[pa.Scalar, ...], stored: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.stored(stored)
        words, (pairs, _), (trigrams, sums) = _totals(answers, UNIGRAM)[0], _totals(answers, BIGRAM), _totals(answers, TRIGRAM)
        step = walked(Automaton(block, n, v, words, pairs, trigrams, sums), block)
        add = lambda x: np.add.reduceat(x, block.first) if len(block.first) else x[:0]
        base = np.log10((words + 1) / (n + v + 1))[block.word]
        return pa.table({"doc_id": block.docs["doc_id"], "held_out": block.docs["held_out"], "n_tokens": pa.array(block.length), "n_known": pa.array(add((words[block.word] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(block.length), n)), "base_score": pa.array(add(base)), "score": pa.array(add(step))})

    return score


def _dealt(docs: DataFrame, blocks: int, parts: int) -> DataFrame:
    """doc_id, held_out, block and z (the lower-case text, compressed), all rows of a block in one partition."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(1)
        for batch in batches:
            z = [small.compress((t or b"").lower()) for t in binary(batch, "text")]  # lower() of bytes changes A-Z alone
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], batch["block"], pa.array(z, pa.binary())], ["doc_id", "held_out", "block", "z"])

    block = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    rows = docs.select("doc_id", "text", "held_out", block.alias("block"))
    return rows.mapInArrow(tidy(squeeze), "doc_id long, held_out boolean, block int, z binary").repartition(parts, "block")


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document of docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES), min(parallelism(spark), size // LEAST_BYTES))
    parts = max(blocks, parallelism(spark))  # a task holds about one block, however large the corpus
    bounded_batches(spark)

    def answered(requests: DataFrame, tag: str) -> DataFrame:
        return materialize(spark, requests.repartition(parts, "shard").groupBy("shard").applyInArrow(_answers, ANSWER_SQL), tag)

    stored = materialize(spark, _dealt(docs, blocks, parts).groupBy("block").applyInArrow(_store, STORED_SQL), "lm-blocks")
    freed(spark)
    first = answered(stored.mapInArrow(tidy(_first_requests(blocks)), REQUEST_SQL), "lm-words")
    n, v = first.agg(F.sum("words"), F.sum("known")).first()
    freed(spark)
    back = lambda df: df.repartition(parts, "block").groupBy("block")
    second = answered(back(stored).cogroup(back(first.where(F.col("kind") == BIGRAM))).applyInArrow(_second_requests(blocks), REQUEST_SQL), "lm-trigrams")
    freed(spark)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return back(stored).cogroup(back(first.union(second))).applyInArrow(_scorer(int(n or 0), int(v or 0)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), FOLDS).alias("held_out")))
