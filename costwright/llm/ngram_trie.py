"""Language-model scoring with an n-gram trie in Elias-Fano levels.

The trie is cut by the first word of its n-grams into shards. Documents are turned into blocks
of token numbers; each block sends every shard the part of its own n-grams that starts with
the shard's words, with training counts. A shard merges these into a trie: per level the
successors as one increasing Elias-Fano sequence (context number, then word), the increasing
pointers to each context's successors, and quantised smoothed probabilities, all in one
memory-mapped buffer. It answers each block by successor search within the context's range, and the
block adds up its documents. Only distinct n-grams of blocks move, packed.

Smoothing is Bayesian with the shorter context as prior:
p(w | context) = (c(context w) + m * p(w | shorter)) / (c(context) + m); the first part and
m / (c(context) + m) are what the levels hold. The shortest is (c(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.llm.bpe import slices
from costwright.llm.jaccard import WordHashes
from costwright.llm.shared import written

ORDER = 3
#: Weight of the shorter context.
PRIOR = 100.0
#: Code 0 is probability 0; codes 1 to CODES are evenly spread in log10 from -DEPTH to 0.
DEPTH, CODES = 8.0, 65535
#: Tokens of all blocks for each shard, which holds up to ORDER - 1 n-grams of each; shards grow in number with the tokens.
SHARD_TOKENS, LEAST_SHARDS = 1_000_000, 8
#: Characters of text in a block.
BLOCK_CHARS = 8_000_000

_U = np.uint64
# No word holds a space, so these are no words.
START, END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")


def quantised(p: np.ndarray) -> np.ndarray:
    codes = np.rint(CODES + np.log10(np.maximum(p, 1e-300)) * ((CODES - 1) / DEPTH))
    return np.where(p > 0, np.clip(codes, 1, CODES), 0).astype("<u2")


#: The probability of each code.
LEVELS = np.concatenate(([0.0], 10 ** ((np.arange(1, CODES + 1) - CODES) * (DEPTH / (CODES - 1)))))


class EliasFano:
    """An increasing sequence of 64-bit numbers: low bytes as planes, high parts in unary, with a rank directory."""

    def __init__(self, low: np.ndarray, bits: np.ndarray, rank: np.ndarray, n: int) -> None:
        self.low, self.bits, self.rank, self.n = low, bits, rank, n

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        if not n:
            return cls(np.zeros((0, 0), np.uint8), np.zeros(8, np.uint8), np.zeros(2, np.uint32), 0)
        planes = 0  # whole bytes, so that high parts need about two bits a value at most
        while planes < 7 and (universe >> (8 * planes)) > n:
            planes += 1
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)
        high = (values >> _U(8 * planes)).astype(np.int64)
        size = n + (universe >> (8 * planes)) + 1
        flags = np.zeros((size + 63) // 64 * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        bits = np.packbits(flags, bitorder="little")
        ones = flags.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        return cls(low, bits, np.concatenate(([0], np.cumsum(ones))).astype(np.uint32), n)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.bits, self.rank]

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the bit of that rank (from 0) among the ones or the zeros."""
        held = self.rank.astype(np.int64)
        before = held if ones else np.arange(len(held)) * 64 - held
        word = np.searchsorted(before, rank, side="right") - 1
        rest = rank - before[word]
        octets = self.bits.reshape(-1, 8)[word]
        if not ones:
            octets = ~octets
        sums = np.cumsum(_POPCOUNT[octets], axis=1, dtype=np.int64)
        octet = (sums <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(rank))
        rest = rest - np.where(octet > 0, sums[rows, octet - 1], 0)
        return word * 64 + octet * 8 + _SELECT[octets[rows, octet], rest]

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), _U)
        for i, plane in enumerate(self.low):
            out |= plane[at].astype(_U) << _U(8 * i)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at places."""
        high = self._select(at, True) - at
        return high.astype(_U) << _U(8 * len(self.low)) | self._low(at)

    def find(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each value within start..end, -1 if it is not there: a successor search."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        shift = _U(8 * len(self.low))
        high = (values >> shift).astype(np.int64)
        low = values & ((_U(1) << shift) - _U(1))
        first = np.zeros(len(values), np.int64)
        later = high > 0
        first[later] = self._select(high[later] - 1, False) - (high[later] - 1)  # values with a smaller high part
        last = np.minimum(self._select(high, False) - high, end)
        at = np.maximum(first, start)
        open_ = np.flatnonzero(at < last)
        # binary search among the low parts of one high part
        lo, hi = at.copy(), last.copy()
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = np.flatnonzero(lo < last)
        hit = hit[self._low(lo[hit]) == low[hit]]
        out[hit] = lo[hit]
        return out


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _SELECT[_byte, : _POPCOUNT[_byte]] = [i for i in range(8) if _byte >> i & 1]


def mapped(sequences: list[EliasFano | np.ndarray]) -> list[EliasFano | np.ndarray]:
    """The same sequences with all their arrays in one memory map."""
    arrays = [a for s in sequences for a in (s.parts() if isinstance(s, EliasFano) else [s])]
    place = mmap.mmap(-1, sum(a.nbytes + 8 for a in arrays) + 8)
    at, views = 0, []
    for a in arrays:
        view = np.frombuffer(place, a.dtype, a.size, at).reshape(a.shape)
        view[...] = a
        views.append(view)
        at += (a.nbytes + 7) // 8 * 8
    out, rest = [], iter(views)
    for s in sequences:
        out.append(EliasFano(next(rest), next(rest), next(rest), s.n) if isinstance(s, EliasFano) else next(rest))
    return out


class Trie:
    """Level 1: the words (64-bit hashes from `first` on). Level k: successors of level k - 1.

    A successor is held as context number << 32 | upper half of the word's hash. With 32 bits two of a
    context's f successors fall together with a chance of f * f / 2 ** 33.
    """

    def __init__(self, first: int, span: int, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray, prior: float) -> None:
        """words: sorted; levels: per level sorted (context << 32 | word) and counts; totals: of level 1 as contexts."""
        self.first = _U(first)
        sequences: list[EliasFano | np.ndarray] = [EliasFano.encode(words - self.first, span)]
        size = len(words)
        for keys, counts in levels:
            context = (keys >> _U(32)).astype(np.int64)
            pointers = np.searchsorted(context, np.arange(size + 1)).astype(_U)
            p = counts / (totals[context] + prior)
            sequences += [
                EliasFano.encode(pointers, len(keys) + 1),
                EliasFano.encode(keys, max(1, size) << 32),
                quantised(p),
                quantised(prior / (totals + prior)),
            ]
            size, totals = len(keys), counts
        self.words, *rest = mapped(sequences)
        self.levels = [rest[i : i + 4] for i in range(0, len(rest), 4)]

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        n = np.full(len(hashes), self.words.n)
        return self.words.find(hashes - self.first, np.zeros(len(hashes), np.int64), n)

    def successors(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams (context number, upper half of the word's hash) on a level, -1 if absent."""
        out = np.full(len(context), -1, np.int64)
        pointers, keys, _, _ = self.levels[level]
        known = np.flatnonzero(context >= 0)
        if len(known):
            own, turn = np.unique(context[known], return_inverse=True)
            start, end = (pointers.access(own + i).astype(np.int64) for i in (0, 1))
            target = context[known].astype(_U) << _U(32) | word[known].astype(_U)
            out[known] = keys.find(target, start[turn], end[turn])
        return out


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned integers, compressed byte plane by byte plane."""
    sizes = np.array([len(arrays), *(len(a) * 16 + a.dtype.itemsize for a in arrays)], "<u8")
    return zstandard.compress(sizes.tobytes() + b"".join(_planes(a) for a in arrays), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    count = int(raw[:8].view("<u8")[0])
    at, out = 8 + 8 * count, []
    for size in raw[8:at].view("<u8").tolist():
        n, width = size >> 4, size & 15
        planes = raw[at : at + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += n * width
    return out


def steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


class Block:
    """Token numbers of a block's documents and its distinct n-grams, level by level."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, ends: np.ndarray, held: np.ndarray, order: int) -> None:
        """words: sorted hashes; tokens: numbers of words; ends: where documents end; held: documents not learned from."""
        self.words, self.tokens, self.ends = words, tokens, ends
        sizes = np.diff(ends, prepend=0)
        learned = np.repeat(~held, sizes)
        place = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
        start = int(np.searchsorted(words, _U(START)))
        self.counts = np.bincount(tokens[learned], minlength=len(words)).astype("<u4")
        node = tokens  # number of the (k - 1)-gram that ends here
        self.at: list[np.ndarray] = []  # per level: the token places that have an n-gram of this length
        self.number: list[np.ndarray] = []  # and its number
        self.context: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        size = len(words)
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 2)
            before = np.where(place[at] > 0, node[at - 1], start) if k == 2 else node[at - 1]
            keys = before.astype(_U) * _U(len(words)) + tokens[at].astype(_U)
            unique, number = np.unique(keys, return_inverse=True)
            self.at.append(at)
            self.number.append(number)
            self.context.append((unique // _U(len(words))).astype(np.int64))
            self.word.append((unique % _U(len(words))).astype(np.int64))
            self.n.append(np.bincount(number[learned[at]], minlength=len(unique)).astype("<u4"))
            node, size = np.zeros(len(tokens), np.int64), len(unique)
            node[at] = number

    def pieces(self, shards: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(shard, what the block has of it): words, counts, the successors' hashes, and per level
        successors a context, their places among those hashes, counts.

        The hashes stand by falling frequency, so places are mostly small and need a third of a hash's bytes.
        """
        shard = _shard(self.words, shards)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        levels = [cuts]
        for context in self.context:
            levels.append(np.searchsorted(context, levels[-1]))
        half = (self.words >> _U(32)).astype("<u4")
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a == b:
                continue
            spans = [levels[k + 1][s : s + 2] for k in range(len(self.context))]
            used = np.bincount(np.concatenate([w[x:y] for w, (x, y) in zip(self.word, spans)] or [np.empty(0, np.int64)]))
            by_use = np.argsort(-used, kind="stable")[: np.count_nonzero(used)]
            place = np.empty(len(used), "<u4")
            place[by_use] = np.arange(len(by_use))
            found = [steps(self.words[a:b]), self.counts[a:b], half[by_use]]
            for k, context in enumerate(self.context):
                (x, y), (c, d) = levels[k + 1][s : s + 2], levels[k][s : s + 2]
                found.append(np.bincount(context[x:y] - c, minlength=d - c).astype("<u4"))
                found += [place[self.word[k][x:y]], self.n[k][x:y]]
            yield s, found


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (((words >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def shard_range(shard: int, shards: int) -> tuple[int, int]:
    """First hash of a shard and how many hashes it spans."""
    first = -(-(shard << 32) // shards) << 32
    return first, (-(-(shard + 1 << 32) // shards) << 32) - first


def answer(shard: int, shards: int, pieces: list[list[np.ndarray]], prior: float) -> tuple[list[list[np.ndarray]], int, int]:
    """Builds a shard's trie from what the blocks sent; their answers, training tokens and known words of the shard.

    An answer: counts of the words; per level codes of the contexts' backoffs and of the n-grams' probabilities.
    """
    words = [np.cumsum(p[0], dtype=_U) for p in pieces]
    depth = (len(pieces[0]) - 3) // 3
    for p in pieces:
        p[4::3] = [p[2][place] for place in p[4::3]]  # hashes again
    vocabulary, number = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(number, np.concatenate([p[1] for p in pieces]), len(vocabulary)).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    nodes = np.split(number, ends[:-1])  # of each block's n-grams of the level above
    levels, totals, size = [], None, len(vocabulary)
    for k in range(depth):
        keys = [
            np.repeat(node, p[3 + 3 * k]).astype(_U) << _U(32) | p[4 + 3 * k].astype(_U) for node, p in zip(nodes, pieces)
        ]
        ends = np.cumsum([len(x) for x in keys])
        keys = np.concatenate(keys)
        unique, number = np.unique(keys, return_inverse=True)
        del keys
        n = np.bincount(number, np.concatenate([p[5 + 3 * k] for p in pieces]), len(unique))
        for p in pieces:
            p[5 + 3 * k] = None  # not read again
        context = (unique >> _U(32)).astype(np.int64)
        if k == 0:
            totals = np.bincount(context, n, size)
        nodes = np.split(number.astype(np.uint32), ends[:-1])
        levels.append((unique, n))
        size = len(unique)
    del nodes, number
    first, span = shard_range(shard, shards)
    # only what training has seen stays in the trie
    kept_words = (counts > 0) | (totals > 0) if depth else counts > 0
    old = kept_words
    new_number = np.cumsum(kept_words) - 1
    trained = []
    for unique, n in levels:
        seen = (n > 0) & old[(unique >> _U(32)).astype(np.int64)]
        context = new_number[(unique >> _U(32)).astype(np.int64)].astype(_U)
        trained.append(((context << _U(32) | unique & _U(0xFFFFFFFF))[seen], n[seen]))
        old, new_number = seen, np.cumsum(seen) - 1
    top = totals[kept_words] if depth else counts[kept_words]
    trie = Trie(first, span, vocabulary[kept_words], trained, top, prior)
    known = counts[kept_words]
    answers = []
    for own, p in zip(words, pieces):
        node = trie.word_numbers(own)
        reply = [np.where(node >= 0, known[node] if len(known) else 0, 0).astype("<u8")]
        for k in range(depth):
            _, _, probability, backoff = trie.levels[k]
            context = np.repeat(node, p[3 + 3 * k])
            reply.append(np.where(node >= 0, backoff[node] if len(backoff) else 0, CODES).astype("<u2"))
            node = trie.successors(k, context, p[4 + 3 * k])
            reply.append(np.where(node >= 0, probability[node] if len(probability) else 0, 0).astype("<u2"))
        answers.append(reply)
    return answers, int(counts.sum()), int((counts > 0).sum())


def scored(block: Block, replies: list[list[np.ndarray]], total: int, distinct: int) -> dict[str, np.ndarray]:
    """Per document: n_tokens, n_known, base_score, score."""
    answers = [np.concatenate(x) for x in zip(*replies)]
    count = answers[0].astype(np.float64)[block.tokens]
    p = (count + 1) / (total + distinct + 1)
    base = np.log10((count + 1) / (total + 1.0 * (distinct + 1)))
    for k in range(len(block.at)):
        backoff, probability = LEVELS[answers[1 + 2 * k]], LEVELS[answers[2 + 2 * k]]
        number = block.number[k]
        p[block.at[k]] = probability[number] + backoff[block.context[k][number]] * p[block.at[k]]
    starts = np.concatenate(([0], block.ends[:-1])).astype(np.int64)
    add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has its end token
    return {
        "n_tokens": np.diff(block.ends, prepend=0),
        "n_known": add((count > 0).astype(np.int64)),
        "base_score": add(base),
        "score": add(np.log10(p)),
    }


def _blocks(docs: DataFrame) -> DataFrame:
    kind = docs.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, block = WordHashes(), TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, held, at = batch.column(0), batch.column(1), 0
            for part in slices([t or "" for t in batch.column(2).to_pylist()], BLOCK_CHARS):
                found, ends = [], []
                size = 0
                for text in part:
                    words = text.encode().lower().split()
                    found.append(np.fromiter(map(memory.__getitem__, words), _U, len(words)))
                    found.append(np.array([END], _U))
                    size += len(words) + 1
                    ends.append(size)
                hashes = np.concatenate([*found, np.array([START], _U)])
                words, tokens = np.unique(hashes, return_inverse=True)
                by_use = np.argsort(-np.bincount(tokens), kind="stable")  # small numbers for frequent words take fewer bytes
                rank = np.empty(len(words), "<u4")
                rank[by_use] = np.arange(len(words))
                data = pack([words[by_use], rank[tokens[:-1]], np.array(ends, "<u8")])
                own = [ids.slice(at, len(part)), held.slice(at, len(part))]
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([size], pa.int64()),
                     *(pa.ListArray.from_arrays([0, len(part)], c) for c in own), pa.array([data], pa.binary())],
                    names=["block", "tokens", "ids", "held", "data"],
                )
                block += 1

    return docs.mapInArrow(
        run, f"block long, tokens long, ids array<{kind.simpleString()}>, held array<boolean>, data binary"
    )


def _load(data: bytes, held: np.ndarray, order: int) -> Block:
    words, tokens, ends = unpack(data)
    place = np.empty(len(words), np.int64)
    place[np.argsort(words)] = np.arange(len(words))
    return Block(np.sort(words), place[tokens], ends.astype(np.int64), held, order)


def score(
    docs: DataFrame,
    held_out: Column,
    id_column: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    prior: float = PRIOR,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from all rows that are not held out (null: not held out). A null text counts as
    empty and has the end token alone. Rows stay one to one, repeated rows included; without
    training rows every word is unknown; an empty table gives no rows.
    """
    chosen = docs.select(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    blocks = written(_blocks(chosen), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-tokens // SHARD_TOKENS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held, data in zip(*(batch.column(i) for i in range(3))):
                block = _load(data.as_py(), np.array(held.as_py(), bool), order)
                rows = [(s, pack(found)) for s, found in block.pieces(shards)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([number.as_py()] * len(rows), pa.int64()),
                     pa.array([r[1] for r in rows], pa.binary())],
                    names=["shard", "block", "data"],
                )

    def merge(sent: pd.DataFrame) -> pd.DataFrame:
        shard = int(sent["shard"].iloc[0])
        answers, total, distinct = answer(shard, shards, [unpack(d) for d in sent["data"]], prior)
        out = pd.DataFrame({"block": sent["block"], "shard": shard, "data": [pack(a) for a in answers]})
        return out.assign(total=[total] + [0] * (len(out) - 1), distinct=[distinct] + [0] * (len(out) - 1))

    messages = blocks.select("block", "held", "data").mapInArrow(send, "shard long, block long, data binary")
    replies = messages.groupBy("shard").applyInPandas(merge, "block long, shard long, data binary, total long, distinct long")
    replies = written(replies, "replies")
    total, distinct = (x or 0 for x in replies.agg(F.sum("total"), F.sum("distinct")).first())

    def finish(own: pa.Table, back: pa.Table) -> pa.Table:
        held = own["held"].combine_chunks().flatten()
        block = _load(own["data"][0].as_py(), held.to_numpy(zero_copy_only=False), order)
        out = scored(block, [unpack(d.as_py()) for d in back.sort_by("shard")["data"]], total, distinct)
        out["train_tokens"] = np.full(len(held), total)
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        arrays = [own["ids"].combine_chunks().flatten(), held, *(pa.array(out[c]) for c in names)]
        return pa.Table.from_arrays(arrays, names=["id", "held_out", *names])

    found = (
        blocks.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(
            finish,
            f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
    return found.withColumnRenamed("id", id_column)
