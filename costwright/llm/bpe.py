"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie. A depth-first walk gives each node the last
token of its prefix's encoding and the node before that token, so shared prefixes are
encoded once; a word's ids are read back along those links. Which token ends a prefix is
unique: the one that may stand after the last token of what precedes it, and two tokens
may stand side by side when the merge rules turn their joined bytes into just these two.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: how byte-level BPE cuts text into words.
_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A word never runs over a space that something visible follows, so text is cut there first.
_CUT = re.compile(r" (?=\S)")

#: Entries of each memory of a worker (cut pieces, words, token pairs); a full one is emptied.
MEMORY = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others follow from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of each id of a tokenizers JSON file, special tokens included."""
    letters = byte_letters()
    found = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    return found | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class ByteBpe:
    """Vocabulary, merge rules and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = as_bytes(a), as_bytes(b)
            self.merged[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.rank, self.parts = dict.fromkeys(self.ids.values(), -1), {}
        for (a, b), (rank, token) in self.merged.items():
            if token not in self.parts:
                self.rank[token], self.parts[token] = rank, (a, b)
        #: each ending of a token -> the token that it is, or -1
        self.endings = {b[k:]: -1 for b in self.ids for k in range(len(b))} | self.ids
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = token_bytes(spec)
        self._special_cut = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)))
        self._beside: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._words: dict[bytes, bytes] = {}
        self._first: dict[str, bytes] = {}
        self._after_space: dict[str, bytes] = {}

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")

    def by_rules(self, data: bytes) -> list[int]:
        """The merge rules applied as they are defined: lowest rank first, leftmost first."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.merged.get(p, (1 << 31, 0)) for p in zip(ids, ids[1:])), default=None)
            if best[0] == 1 << 31:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merged.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _seam_holds(self, left: int, right: int) -> bool:
        """Whether no merge crosses the seam between two encoded tokens.

        Undoes the merges on both sides from the last to the first; the seam breaks if two
        parts that touch there would have merged before the next merge beside them. Of
        equal merges the left one comes first.
        """
        limit = 1 << 31
        while True:
            if self.merged.get((left, right), (limit,))[0] < limit:
                return False
            on_left, on_right = self.rank[left], self.rank[right]
            if on_left > on_right:
                limit, left = on_left, self.parts[left][1]
            elif on_right >= 0:
                limit, right = on_right + 1, self.parts[right][0]
            else:
                return True

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether right may stand after left (-1: at the start) in an encoding."""
        alone = self._alone.get(right)
        if alone is None:
            alone = self._alone[right] = self.by_rules(self.token[right]) == [right]
        return alone and (left < 0 or self._seam_holds(left, right))

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct words, through one trie over all of them.

        In sorted order a word branches off the path of the one before it, so nodes are made in the order in which
        a depth-first walk meets them, and a node gets its state when it is made: the last token of
        its prefix and the node before that token.
        """
        last, before = array("i", [-1]), array("I", [0])
        if len(self._beside) > MEMORY:
            self._beside.clear()
        endings, beside = self.endings, self._beside
        out: dict[bytes, tuple[int, ...]] = {}
        path, previous = [0], b""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                path.append(len(last))
                for start in range(depth - 1, -1, -1):
                    token = endings.get(word[start:depth], -1)
                    if token >= 0:
                        node = path[start]
                        pair = last[node] << 32 | token
                        known = beside.get(pair)
                        if known is None:
                            known = beside[pair] = self._may_follow(last[node], token)
                        if known:
                            last.append(token)
                            before.append(node)
                            break
                else:  # never with a vocabulary that has all bytes
                    raise ValueError(f"no token ends {word[:depth]!r}")
            previous, node, back = word, path[-1], []
            while node:
                back.append(last[node])
                node = before[node]
            out[word] = tuple(back[::-1])
        return out

    def _learn(self, pieces: set[str], memory: dict[str, bytes], lead: str) -> None:
        """Adds the ids of cut pieces, little-endian, to a memory."""
        cut = {p: [w.encode() for w in _WORDS.findall(lead + p)] for p in pieces}
        if len(self._words) > MEMORY:
            self._words.clear()
        known = self._words
        new = {w for ws in cut.values() for w in ws if w not in known}
        known.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w, ids in self.encode_words(new).items())
        memory.update((p, b"".join([known[w] for w in ws])) for p, ws in cut.items())

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = [_CUT.split(t) if "  " in t or not t.isascii() or not t.isprintable() else t.split(" ") for t in texts]
        parts = [p if all(p[1:]) else _CUT.split(t) for p, t in zip(parts, texts)]
        if len(self._after_space) > MEMORY:
            self._after_space.clear()
        if len(self._first) > MEMORY:
            self._first.clear()
        first, rest = self._first, self._after_space
        self._learn({p[0] for p in parts} - first.keys(), first, "")
        self._learn({w for p in parts for w in p[1:]} - rest.keys(), rest, " ")
        return [first[p[0]] + b"".join([rest[w] for w in p[1:]]) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole, cuts = [], []
        for text in texts:
            specials = self._special_cut.findall(text) if self.special else []
            segments = self._special_cut.split(text) if specials else [text]
            cuts.append((len(whole), len(segments), specials))
            whole += segments
        coded = self._plain(whole)
        out = []
        for at, n, specials in cuts:
            parts = [coded[at]]
            for special, code in zip(specials, coded[at + 1 : at + n]):
                parts += [np.array([self.special[special]], "<u4").tobytes(), code]
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One per worker and file."""
    return ByteBpe(path)


#: Characters of text that are encoded together; bounds a worker's memory.
BATCH_CHARS = 3_000_000


def slices(texts: Iterable[str | None] | pa.Array, most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """texts in runs of at most `most` characters, or one text that is longer; null counts as empty.

    Values of an Arrow array become Python's a run at a time.
    """
    run, size = [], 0
    for text in texts:
        text = (text.as_py() if isinstance(text, pa.Scalar) else text) or ""
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encode(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    decoded: str | None = None,
) -> DataFrame:
    """The kept columns of every row with `ids`: its text's ids, little-endian unsigned 32-bit.

    Whole texts; a null text counts as empty and an empty one has no ids. Special tokens
    in a text become their ids. With `decoded` a further column of that name has the text that the ids
    give back, from the same pass and the same vocabulary in memory. Rows stay one to one,
    repeated rows included; an empty table gives no rows; other columns are not read. No shuffle.
    """
    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    names = [*keep, "ids", *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts, at = batch.column(len(keep)), 0
            for part in slices(texts):
                kept = [c.slice(at, len(part)) for c in batch.columns[: len(keep)]]
                at += len(part)
                ids = bpe.encode(part)
                columns = [*kept, pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(bpe.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return chosen.mapInArrow(run, f"{schema}, ids binary" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, vocabulary: str, text: str = "decoded") -> DataFrame:
    """Rows with `ids` as made by encode(), with their decoded text in a further column; null ids give an empty text."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = [bpe.decode(i or b"") for i in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, `{text}` string")
