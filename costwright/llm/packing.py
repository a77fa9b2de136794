"""Harmonic packing of token sequences.

A length l belongs to the class of reciprocal capacity k = capacity // l: k pieces of that
class fill one sequence. Documents may be cut, so a document gives pieces of exactly
capacity // k tokens, the largest that fits first, until the rest is short enough to
waste little in its own class. Every worker fills the sequences of each class with k pieces each,
independent of all others. The at most k - 1 pieces of a class that it is left with go to one
task for each group of workers, which fills sequences of a class in the same way and puts
the last few pieces of all classes together, longest first.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from costwright.llm.bpe import byte_letters, slices
from costwright.llm.shared import written

CAPACITY = 4096
END_ID = 2
#: A rest is kept whole when its class leaves at most this share of a sequence empty.
WASTE = 0.01
#: Workers whose remainders meet in one task; a worker leaves some thousands of pieces at most.
WORKERS = 64
#: Entries of a worker's memory of words; a full one is emptied.
MEMORY = 800_000

# Fixed value: how the tokenizer cuts normalised text into words; white space is dropped.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: The same for lower-case text whose letters are all Latin and all else ASCII.
_LATIN = "a-z\xdf-\xf6\xf8-\u024f"
_LATIN_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]|[^\x20\x09-\x0D0-9{_LATIN}]+")
_NOT_LATIN = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")


class Words(dict):
    """Ids of words by a tokenizers file whose words drop white space, as a memory.

    Texts are normalised and cut here, the library's model encodes every distinct word once.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        known = self[word] = np.array([t.id for t in tokens], "<u4").tobytes()
        return known

    def ids(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit."""
        if "<|" in text:  # may hold a special token, which is found before normalising
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        low = text.lower()  # some Latin capitals have small letters beyond the range
        if text.isascii() or not _NOT_LATIN.search(text) and not _NOT_LATIN.search(low) and unicodedata.is_normalized("NFC", text):
            words = _LATIN_WORDS.findall(low)
        else:
            words = _WORDS.findall(self.normalizer.normalize_str(text))
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    """One per worker and file."""
    return Words(path)


def cuts(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of that many tokens."""
    pieces = []
    while length:
        k = max(1, capacity // length)
        if k * length > capacity or capacity - k * length <= waste * capacity:
            pieces.append(min(length, capacity))
        else:
            pieces.append(capacity // (k + 1))
        length -= pieces[-1]
    return pieces


class Filling:
    """The open sequence of each class; gives a full one's pieces their places."""

    def __init__(self, first: int, capacity: int) -> None:
        self.open: dict[int, list[int]] = {}
        self.next, self.capacity = first, capacity
        self.length: list[int] = []
        self.place: list[tuple[int, int] | None] = []

    def add(self, length: int) -> None:
        k, row = self.capacity // length, len(self.length)
        self.length.append(length)
        self.place.append(None)
        rows = self.open.setdefault(k, [])
        rows.append(row)
        if len(rows) == k:
            self.put(self.open.pop(k))

    def put(self, rows: list[int]) -> None:
        at = 0
        for row in rows:
            self.place[row] = (self.next, at)
            at += self.length[row]
        self.next += 1

    def finish(self) -> None:
        """Best fit, longest first, of what the classes have left."""
        rest = sorted((row for rows in self.open.values() for row in rows), key=lambda r: -self.length[r])
        by_room: dict[int, list[list[int]]] = {}
        rooms: list[int] = []
        for row in rest:
            length = self.length[row]
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                held = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(i)
            else:
                room, held = self.capacity, []
            held.append(row)
            room -= length
            if not by_room.setdefault(room, []):
                insort(rooms, room)
            by_room[room].append(held)
        for helds in by_room.values():
            for held in helds:
                self.put(held)
        self.open = {}


def _columns(kind: str, id_column: str, with_ids: bool) -> str:
    return (
        f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        f"sequence_id long, offset long, worker long" + ", ids binary" * with_ids
    )


def _by_worker(docs: DataFrame, vocabulary: str, capacity: int, waste: float, end_id: int, with_ids: bool) -> DataFrame:
    """Every piece; those that this worker could not place have a null sequence_id."""
    id_column = docs.columns[0]
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "worker"]
    names += ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = load(vocabulary), np.array([end_id], "<u4").tobytes()
        worker = TaskContext.get().partitionId()
        fill = Filling(worker << 32, capacity)
        waiting: list[tuple] = []  # pieces without a place yet, by their rows in fill

        def emit(rows: list[tuple], places: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 6
            where = list(zip(*((None, None) if p is None else p for p in places))) or [(), ()]
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in (*cols[1:5], *where))]
            arrays.append(pa.array([worker] * len(rows), pa.int64()))
            arrays += [pa.array(cols[5], pa.binary())] * with_ids
            return pa.RecordBatch.from_arrays(arrays, names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts, at = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0
            for part in slices(texts):
                for i, content in enumerate(part):
                    code = words.ids(content) + end
                    start, total = 0, len(code) // 4
                    for length in cuts(total, capacity, waste):
                        piece = code[4 * start : 4 * (start + length)]
                        waiting.append((ids[at + i], start, length, zlib.crc32(piece), total, piece if with_ids else None))
                        fill.add(length)
                        start += length
                at += len(part)
                placed = [i for i, p in enumerate(fill.place) if p is not None]
                yield emit([waiting[i] for i in placed], [fill.place[i] for i in placed])
                # the pieces that still wait are numbered anew
                left = [i for i, p in enumerate(fill.place) if p is None]
                new = {old: i for i, old in enumerate(left)}
                waiting = [waiting[i] for i in left]
                fill.length, fill.place = [fill.length[i] for i in left], [None] * len(left)
                fill.open = {k: [new[r] for r in rows] for k, rows in fill.open.items()}
        yield emit(waiting, [None] * len(waiting))

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.mapInArrow(run, _columns(kind, id_column, with_ids))


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    waste: float = WASTE,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with_ids: and ids).

    A null text counts as empty and gives its end id alone; a null id stays null; repeated
    rows are packed each for itself; an empty table gives no rows; other columns are not read.
    Pieces in a sequence lie without gaps from offset 0. Only the remainders of workers move.
    """
    chosen = docs.select(id_column, text)
    kind = chosen.schema[id_column].dataType.simpleString()
    pieces = written(_by_worker(chosen, vocabulary, capacity, waste, end_id, with_ids), "pieces")

    def finish(rest: pd.DataFrame) -> pd.DataFrame:
        fill = Filling(1 << 62 | int(rest["worker"].iloc[0]) // WORKERS << 32, capacity)
        for length in rest["length"]:
            fill.add(length)
        fill.finish()
        return rest.assign(sequence_id=[p[0] for p in fill.place], offset=[p[1] for p in fill.place])

    placed, rest = pieces.filter("sequence_id is not null"), pieces.filter("sequence_id is null")
    group = F.floor(F.col("worker") / WORKERS)
    rest = rest.groupBy(group).applyInPandas(finish, _columns(kind, id_column, with_ids))
    return placed.unionByName(rest).drop("worker")
