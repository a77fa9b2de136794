"""N-gram Jaccard join by vertical partitioning.

A text's set is its distinct word shingles, as 64-bit hashes; the hash order is the global
order of n-grams. Vertical cuts of that order find the pairs:

* To find pairs. Two sets of size at most m whose Jaccard similarity reaches the threshold
  differ in at most d(m) shingles, so of more than d(m) fragments one at least is equal in both. Each
  set gives signatures of non-empty fragments, for the size bands in which it can have
  partners: as many as differ from a partner at most, and one more, those of most shingles first. As
  all sets have the same order, the first fragment that a pair shares is given by both. Sets that are empty in too
  many fragments to have as many give signatures of empty fragments too, so no pair is missed.
* To drop pairs before their texts move: when the sets' sizes are too far apart or when their parity
  bitmaps, which are as long as the sets, differ in more bits than the sets may in shingles. What is left is
  verified by the exact intersection.

Equal sets are one node from the start. Signatures that the same nodes share are one. The members of a
signature are compared by size and bitmap in cells of bounded size. In the first round a cell gives a spanning
forest of the pairs that may link, the likeliest first, so a family of any size sends about as many pairs as it has
members; in the second it gives all pairs that may link and are still in different components. So
no link between different texts that matters for a component is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.llm.bpe import slices
from costwright.llm.components import components
from costwright.llm.shared import marked, removed, repeated_keys, written

WORDS, PERCENT = 4, 85
#: Members of a signature that are compared in one cell; of more, each two chunks of so many are a cell.
CELL = 1024
#: Nodes that are compared with one node in a group of texts; more are several groups.
FAN = 64
#: Bits of a set's parity bitmap, at least and at most; between them the power of two that reaches the set's size.
#: Each shingle flips one bit, so two bitmaps differ in no more bits than their sets; one with too few rules nothing out.
SKETCH_BITS, LONGEST_SKETCH = 1024, 1 << 16
#: Documents of one shard of signatures; shards grow in number with the documents.
SHARD_DOCS = 8192
#: Words whose hash a worker remembers; a full memory is emptied.
MEMORY = 400_000

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        known = self[word] = xxhash.xxh64_intdigest(word)
        return known

    def shingles(self, text: str | None, size: int) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle; none without words."""
        words = (text or "").encode().lower().split()  # bytes: lower() takes A-Z only, split() the ASCII spaces
        if not words:
            return np.empty(0, _U)
        hashes = np.fromiter(map(self.__getitem__, words), _U, len(words))
        size = min(size, len(words))
        total = np.full(len(words) - size + 1, size, _U)
        for j in range(size):
            total = total * _U(0x9E3779B97F4A7C15) + hashes[j : len(words) - size + 1 + j]
        return np.unique(mixed(total))


@lru_cache(maxsize=4096)
def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(number, end) of the size bands in which a set of that size can have a partner of at least its size.

    Bands run from an end to one half larger. A set belongs to its own band and to every later one
    that begins within its reach; the larger set of a pair decides where the two meet.
    """
    found, band, start = [], 0, 1
    while 100 * size >= percent * start:
        end = max(start + 1, start * 3 // 2)
        if size < end:
            found.append((band, end))
        band, start = band + 1, end
    return found


def cuts(band_end: int, percent: int) -> tuple[int, int]:
    """(most shingles that differ, number of fragments) for sets below band_end.

    |A ^ B| <= (100 - p) / (100 + p) * (|A| + |B|) when the similarity is p percent or more.
    """
    differ = (100 - percent) * 2 * (band_end - 1) // (100 + percent)
    return differ, differ + 3 + differ // 8


def signatures(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set: whoever is similar enough and not equal shares one of them.

    Of k non-empty fragments a partner shares all but `differ`. In an order that all sets have in
    common, the first shared one is thus among the first differ + 1 of either set; later ones are not given.
    Fragments of many shingles come first: those of one shingle are what unrelated texts share by a common phrase.
    """
    found, size = [], len(hashes)
    for band, end in bands(size, percent):
        # from a partner of this band
        differ = (100 - percent) * (size + min(100 * size // percent, end - 1)) // (100 + percent)
        if differ:  # else only equal sets are similar
            _, fragments = cuts(end, percent)
            at = ((hashes >> _U(32)) * _U(fragments)) >> _U(32)
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            place = mixed(at[starts] + _U((band + 1) << 32))
            own = mixed(np.add.reduceat(mixed(hashes), starts) ^ place)
            if len(starts) > differ + 1:
                own = own[np.lexsort((own, -np.diff(starts, append=size)))[: differ + 1]]
            found.append(own)
            if len(starts) <= differ:
                empty = np.setdiff1d(np.arange(fragments, dtype=_U), at[starts], assume_unique=True)
                found.append(mixed(mixed(empty + _U((band + 1) << 32)) + _U(1)))
    return np.concatenate(found) if found else np.empty(0, _U)


def packed(sigs: np.ndarray, rows: np.ndarray) -> bytes:
    """Sorted signatures and the rows that they come from, compressed."""
    steps = np.diff(sigs, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(steps.tobytes() + rows.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(_U).ravel()
    rows = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=_U), rows.astype(np.int64)


_KINDS = (
    "kind string, block long, row long, id {id}, n long, node long, content long, bits array<long>, "
    "sig long, shard long, data binary"
)


def node_of(hashes: np.ndarray) -> int:
    """A hash of a set."""
    return int(np.add.reduce(mixed(hashes ^ _U(len(hashes)))).view(np.int64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as 64-bit numbers."""
    size = min(max(SKETCH_BITS, 1 << (len(hashes) - 1).bit_length()), LONGEST_SKETCH)
    odd = np.bincount((hashes % _U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row for each of the bitmaps that lie one after another, all as long as the shortest: halves are
    combined by exclusive or, which gives the parities of fewer bits."""
    width, ends = int(lengths.min()), np.cumsum(lengths)
    if ends[-1] == width * len(lengths):
        return bits.reshape(-1, width)
    rows = np.empty((len(lengths), width), bits.dtype)
    for i, (end, length) in enumerate(zip(ends.tolist(), lengths.tolist())):
        rows[i] = np.bitwise_xor.reduce(bits[end - length : end].reshape(-1, width), axis=0)
    return rows


def _content(text: str) -> Column:
    """A hash of the text itself, by which its row is found again."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _scan(docs: DataFrame, words: int, percent: int, shards: int) -> DataFrame:
    """One pass over the texts. Rows of kind
    doc: id, set size n, node (a hash of the set; null for an empty one), hash of the text and bitmap of each document;
    near: block, row and signature of nodes that share a signature with another of their block;
    send: the distinct signatures of a block that belong to a shard, each with one of its rows.
    """
    kind = docs.schema[0].dataType
    names = ["kind", "block", "row", "id", "n", "node", "content", "bits", "sig", "shard", "data"]

    def batch_of(count: int, id_type: pa.DataType, kind: str, block: int, **cols: pa.Array) -> pa.RecordBatch:
        types = {"id": id_type, "data": pa.binary(), "bits": pa.list_(pa.int64())}
        fixed = {"kind": pa.array([kind] * count, pa.string()), "block": pa.array([block] * count, pa.int64())}
        given = fixed | cols
        arrays = [given[c] if c in given else pa.nulls(count, types.get(c, pa.int64())) for c in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, block = WordHashes(), TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in slices(batch.column(1)):
                sizes, nodes, bits, own, sigs, rows = [], [], [], set(), [], []
                for row, text in enumerate(part):
                    hashes = memory.shingles(text, words)
                    sizes.append(len(hashes))
                    if not len(hashes):
                        nodes.append(None)
                        bits.append(None)
                        continue
                    node = node_of(hashes)
                    nodes.append(node)
                    bits.append(bitmap(hashes))
                    if node not in own:
                        own.add(node)
                        found = signatures(hashes, percent)
                        sigs.append(found)
                        rows.append(np.full(len(found), row))
                kept, content = ids.slice(at, len(part)), batch.column(2).slice(at, len(part))
                at += len(part)
                count = pa.array(range(len(part)), pa.int64())
                yield batch_of(len(part), ids.type, "doc", block, row=count, id=kept, content=content,
                               n=pa.array(sizes, pa.int64()), node=pa.array(nodes, pa.int64()),
                               bits=pa.array(bits, pa.list_(pa.int64())))
                if sigs:
                    sig, row = np.concatenate(sigs), np.concatenate(rows)
                    order = np.argsort(sig, kind="stable")
                    sig, row = sig[order], row[order]
                    first = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.empty(0, bool)
                    many = ~first | ~np.concatenate((first[1:], [True])) if len(sig) else first
                    yield batch_of(int(many.sum()), ids.type, "near", block, row=pa.array(row[many], pa.int64()),
                                   sig=pa.array(sig[many].view(np.int64)))
                    sig, row = sig[first], row[first]
                    shard = (((sig >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)
                    ends = np.searchsorted(shard, np.arange(shards + 1))
                    full = [s for s in range(shards) if ends[s] < ends[s + 1]]
                    data = [packed(sig[ends[s] : ends[s + 1]], row[ends[s] : ends[s + 1]]) for s in full]
                    yield batch_of(len(full), ids.type, "send", block, shard=pa.array(full, pa.int64()),
                                   data=pa.array(data, pa.binary()))
                block += 1

    return docs.mapInArrow(run, _KINDS.format(id=kind.simpleString()))


def _shared(sent: pd.DataFrame) -> pd.DataFrame:
    """Block, row and signature of all signatures of a shard that come from two blocks or more."""
    parts = [unpacked(data) for data in sent["data"]]
    sig = np.concatenate([p[0] for p in parts])
    row = np.concatenate([p[1] for p in parts])
    block = np.repeat(sent["block"].to_numpy(), [len(p[0]) for p in parts])
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    many = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return pd.DataFrame({"block": block[order][many], "row": row[order][many], "sig": sig[many].view(np.int64)})


def _may_link(n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """A number for each two sets: the share of their shingles that differ by their bitmaps, which
    is never too large, or infinity where sizes or bitmaps rule the similarity out."""
    far = np.full((len(n), len(n)), np.inf, np.float32)
    step = max(1, (1 << 22) // bits.size)  # so that a step's bitmaps stay in 32 MB
    for i in range(0, len(n), step):
        own = slice(i, i + step)
        differ = np.bitwise_count(bits[own, None] ^ bits[None]).sum(-1, dtype=np.int64)
        total, least = n[own, None] + n[None], np.minimum(n[own, None], n[None])
        may = (100 * least >= percent * (total - least)) & ((100 + percent) * differ <= (100 - percent) * total)
        far[own][may] = (differ / total)[may]
    np.fill_diagonal(far, np.inf)
    return far


def _forest(far: np.ndarray) -> tuple[list[int], list[int]]:
    """The two ends of each edge of a least spanning forest (Prim) of a matrix of distances."""
    near, parent, left = np.full(len(far), np.inf, np.float32), np.zeros(len(far), np.int64), len(far)
    done, ends = np.zeros(len(far), bool), ([], [])
    while left:
        at = int(np.argmin(near))
        if near[at] < np.inf:
            ends[0].append(int(parent[at]))
            ends[1].append(at)
        else:
            at = int(np.argmin(done))  # the first of another tree
        done[at], left = True, left - 1
        closer = (far[at] < near) & ~done
        near[closer], parent[closer] = far[at][closer], at
        near[at] = np.inf
    return ends


def _candidates(members: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes of a signature in different components that may link.

    members: sig, members (their number), node, component, n and bits. With whole all such pairs, else a
    spanning forest of those of each cell, the likeliest first.
    """
    chunks = F.ceil(F.col("members") / CELL).cast("int")
    cells = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), chunks).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    key = ["sig", "lo", "hi"]
    cells = cells.select(
        "sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        "own", "node", "component", "n", "bits",
    )

    def pairs_of(
        lo: int, hi: int, own: np.ndarray, node: np.ndarray, component: np.ndarray, n: np.ndarray, lengths: np.ndarray, bits: np.ndarray
    ) -> np.ndarray:
        far = _may_link(n, folded(bits, lengths), percent)
        far[component[:, None] == component[None]] = np.inf
        if lo < hi:  # the chunks have cells of their own
            far[own[:, None] == own[None]] = np.inf
        i, j = np.nonzero(np.triu(far < np.inf)) if whole else map(np.array, _forest(far))
        if not len(i):
            return np.empty((2, 0), np.int64)
        return np.array([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # the last cell so far, which may go on in the next batch

        def found(parts: list[list[np.ndarray]]) -> np.ndarray:
            _, lo, hi, *columns = (np.concatenate(c) for c in zip(*parts))
            return pairs_of(int(lo[0]), int(hi[0]), *columns) if len(lo) > 1 else np.empty((2, 0), np.int64)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            columns.append(batch.columns[-1].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            bits = batch.columns[-1].flatten().to_numpy(zero_copy_only=False).view(_U)
            ends = np.concatenate(([0], np.cumsum(columns[-1])))
            new = np.any([c[1:] != c[:-1] for c in columns[: len(key)]], axis=0)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            pairs = []
            for start, end in zip(starts, starts[1:]):
                part = [*(c[start:end] for c in columns), bits[ends[start] : ends[end]]]
                if rest and any(part[k][0] != rest[-1][k][0] for k in range(len(key))):
                    pairs.append(found(rest))
                    rest = []
                rest.append(part)
            rest = [[c.copy() for c in part] for part in rest]
            if pairs:
                yield _pairs(np.concatenate(pairs, axis=1))
        if rest:
            yield _pairs(found(rest))

    # a cell's rows lie together after the sort
    dealt = cells.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(ends: np.ndarray) -> pa.RecordBatch:
    a, b = np.unique(ends, axis=1) if ends.shape[1] else ends
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The written pairs (a, b) that are similar enough, by the exact size of the intersection.

    Texts of the sets that occur in pairs are found again by a hash of their content, behind a bitmap
    of fixed size in the scan, so other texts do not move. The text of a meets those of its b, FAN at a time.
    """
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("fans"))
    dealt = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(2)), F.col("fans")).alias("fan"))
    wanted = dealt.select("a", "fan", F.col("b").alias("node")).unionByName(
        dealt.select("a", "fan", F.col("a").alias("node")).distinct()
    )
    wanted = written(wanted.join(sets.select("node", "content"), "node"), "wanted")
    marks = written(repeated_keys(wanted, F.col("content"), least=1), "marks")
    found = marked(docs.select("text", "content"), F.col("content"), marks, "may").filter("may")
    # copies of a text are one
    texts = found.groupBy("content").agg(F.min("text").alias("text"))
    placed = texts.join(wanted, "content").select("text", "node", "a", "fan", (F.col("node") != F.col("a")).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, base, base_of = WordHashes(), np.empty(0, _U), None
        for batch in batches:
            nodes, a, fans = (batch.column(k).to_pylist() for k in (1, 2, 3))
            at, linked = 0, []
            for part in slices(batch.column(0)):
                for text, node, key in zip(part, nodes[at:], zip(a[at:], fans[at:])):
                    hashes = memory.shingles(text, words)
                    if not len(hashes) or node_of(hashes) != node:
                        continue
                    if node == key[0]:
                        base, base_of = hashes, key
                    elif base_of == key:
                        place = np.minimum(np.searchsorted(base, hashes), len(base) - 1)
                        both = int(np.count_nonzero(base[place] == hashes))
                        if 100 * both >= percent * (len(base) + len(hashes) - both):
                            linked.append((key[0], node))
                at += len(part)
            yield _pairs(np.array(linked, np.int64).reshape(-1, 2).T)

    grouped = placed.repartition("a", "fan").sortWithinPartitions("a", "fan", "other")
    links = written(grouped.mapInArrow(run, "a long, b long"), "links")
    for used in (wanted, marks):
        removed(used)
    return links


def similar_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """id, n_shingles and component_id of every row: the least id reachable by links, itself included.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their shingle sets. Null and
    empty texts have the empty set and link with nothing. Equal sets always link, repeated rows
    among them. A null id stays null and never is the least one of a group unless all are null;
    an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), _content(text).alias("content"))
    shards = max(8, -(-docs.count() // SHARD_DOCS))
    scanned = written(_scan(docs, words, percent, shards), "signatures")
    nodes = scanned.filter("kind = 'doc'").select("block", "row", "id", "n", "node", "content", "bits")
    sent = scanned.filter("kind = 'send'").select("shard", "block", "data")
    near = scanned.filter("kind = 'near'").select("block", "row", "sig")
    across = sent.groupBy("shard").applyInPandas(_shared, "block long, row long, sig long").select("block", "row", "sig")
    members = near.unionByName(across).join(nodes.select("block", "row", "node"), ["block", "row"])
    members = written(members.select("sig", "node").distinct(), "members")
    sets = nodes.filter("node is not null").groupBy("node").agg(F.min(F.struct("content", "n", "bits")).alias("s"))
    sets = written(sets.select("node", "s.*"), "sets")
    nodes = written(nodes.select("id", "n", "node"), "nodes")
    removed(scanned)

    # of signatures with the same members one is enough
    shared = (
        members.groupBy("sig")
        .agg(
            F.min("node").alias("a"),
            F.count(F.lit(1)).alias("members"),
            F.expr("bit_xor(xxhash64(node))").alias("x"),
            F.expr("bit_xor(xxhash64(node, 1))").alias("y"),
        )
        .filter("members > 1")
    )
    shared = shared.groupBy("a", "members", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "members")
    chosen = written(members.join(shared, "sig"), "members")
    removed(members)

    features = sets.select("node", "n", "bits")
    first = chosen.join(features, "node").withColumn("component", F.col("node"))
    pairs = written(_candidates(first, percent, whole=False), "pairs")
    grouped = components(_linked(pairs, docs, sets, words, percent))

    # two members were compared by the first round; more are where they are still apart
    apart = chosen.filter("members > 2").join(grouped, "node", "left").select(
        "sig", "members", "node", F.coalesce("component", "node").alias("component")
    )
    open_sigs = apart.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    apart = apart.join(open_sigs.select("sig"), "sig").join(features, "node")
    others = written(_candidates(apart, percent, whole=True).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = _linked(others, docs, sets, words, percent)
    for used in (chosen, sets, pairs, others):
        removed(used)
    # what the first round has joined is a link to its least node
    final = grouped if more.isEmpty() else components(
        more.unionByName(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")))
    )

    found = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = found.filter("node is not null").groupBy("component").agg(F.min("id").alias("smallest"))
    return found.join(smallest, "component", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.expr("if(node is null, id, smallest)").alias("component_id"),
    )
