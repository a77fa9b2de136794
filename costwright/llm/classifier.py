"""Quality classifier with supervised subword embeddings.

Every word gives a hashed word feature and hashed character n-grams of `<word>`; a word that
repeats the one before it gives one more, the same for all words. The vectors
of a document's features are averaged and a softmax layer over the average gives its class;
vectors and layer are learned together by stochastic gradient descent in numpy. The
learning rows are a bounded sample; scoring covers every row in one pass. As the layer is
linear in the average, a word's share of the result is summed once for each word of a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
SEED = 7

#: Bounds of the learning sample: rows of class 0 and 1, and code points of a text to be learned from.
SAMPLE_ROWS = (2000, 6000)
SAMPLE_CHARS = 20_000
#: Words that a task remembers; a full memory is emptied.
MEMORY = 400_000


def features(word: bytes) -> list[int]:
    """Buckets of a word and of the character n-grams (in bytes) of the word between marks."""
    marked = b"<" + word + b">"
    found = [zlib.crc32(word) % BUCKETS]
    for n in GRAMS:
        found += [zlib.crc32(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return found


#: The feature of a word that repeats the one before it.
AGAIN = zlib.crc32(b"\x00again") % BUCKETS


def repeats(words: list[bytes]) -> int:
    return sum(map(eq, words, words[1:]))


@dataclass
class SubwordModel:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def shares(self) -> np.ndarray:
        """What each bucket adds to the log odds of class 1 before averaging."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float64)

    def odds(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> SubwordModel:
    """Learns from texts and their classes 0 and 1. Without texts every score is 0.5."""
    rng = np.random.default_rng(SEED)
    model = SubwordModel(
        rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32),
        np.zeros((2, DIM), np.float32),
        np.zeros(2, np.float32),
    )
    known: dict[bytes, np.ndarray] = {}
    rows = []
    for text in texts:
        words = text.encode().split()
        for word in words:
            if word not in known:
                known[word] = np.array(features(word), np.int32)
        found = np.concatenate([*(known[w] for w in words), np.full(repeats(words), AGAIN, np.int32)])
        buckets, counts = np.unique(found, return_counts=True)
        rows.append((buckets, (counts / max(1, len(found))).astype(np.float32)))
        if len(known) > MEMORY // 4:
            known.clear()
    steps = epochs * len(rows)
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, weights = rows[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            mean = weights @ model.vectors[buckets]
            logits = model.layer @ mean + model.bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = model.layer.T @ p
            model.layer -= lr * np.outer(p, mean)
            model.bias -= lr * p
            # each vector moves by the whole step, not by its share of the average
            model.vectors[buckets] -= lr * np.minimum(1, weights * len(buckets))[:, None] * back
    return model


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, rows: tuple[int, int]) -> DataFrame:
    """__id, __label and __text of at most rows[c] labelled texts of each class c, chosen by a hash of their ids.

    labels: id_column and `quality`; ids with several labels count as 1 if any is. Null ids,
    texts and labels, and texts over SAMPLE_CHARS, are not learned from. Of rows that share an id the one with
    the least hash of its text is, so the sample does not depend on how rows are stored. Empty tables give an
    empty sample. Other columns are not read, whatever their names.
    """
    known = (
        labels.filter(F.col(id_column).isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col(id_column).alias("__id"))
        .agg(F.max("quality").alias("__label"))
    )
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = [known.filter(F.col("__label") == c).orderBy(*order).limit(rows[c]) for c in (0, 1)]
    bounded = F.broadcast(picked[0].unionByName(picked[1]))  # at most sum(rows) ids
    return (
        docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"))
        .filter(F.length("__text") <= SAMPLE_CHARS)
        .join(bounded, "__id")
        .groupBy("__id", "__label")
        .agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("__least"))
        .select("__id", "__label", "__least.__text")
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    rows: tuple[int, int] = SAMPLE_ROWS,
) -> SubwordModel:
    """A model learned from a bounded sample of the labelled rows.

    One task learns, so neither texts nor their features reach the driver; only the model does, whose size is fixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(batches):
            rows = pa.Table.from_batches(found).sort_by("__id")
            model = train(rows.column("__text").to_pylist(), rows.column("__label").to_pylist())
            parts = [pa.array([x.tobytes()], pa.binary()) for x in (model.vectors, model.layer, model.bias)]
            yield pa.RecordBatch.from_arrays(parts, names=["vectors", "layer", "bias"])

    learning = sample(docs, labels, id_column, text, rows).repartition(1)
    learned = learning.mapInArrow(run, "vectors binary, layer binary, bias binary").first()
    if not learned:
        return train([], [])
    vectors, layer, bias = (np.frombuffer(x, np.float32) for x in learned)
    return SubwordModel(vectors.reshape(BUCKETS, DIM), layer.reshape(2, DIM), bias)


class Scorer(dict):
    """Word -> (what it adds to the log odds, number of its features)."""

    def __init__(self, shares: np.ndarray, odds: float) -> None:
        super().__init__()
        self.shares, self.odds = shares, odds

    def __missing__(self, word: bytes) -> tuple[float, int]:
        if len(self) >= MEMORY:
            self.clear()
        found = features(word)
        known = self[word] = (float(self.shares[found].sum()), len(found))
        return known

    def score(self, text: str | None) -> float:
        words = (text or "").encode().split()
        pairs, again = [self[w] for w in words], repeats(words)
        total = math.fsum(p[0] for p in pairs) + again * float(self.shares[AGAIN])
        total /= max(1, sum(p[1] for p in pairs) + again)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total + self.odds))))


def score(docs: DataFrame, model: SubwordModel, text: str = "text", score: str = "score") -> DataFrame:
    """All rows and columns of docs with the probability of class 1 in a further column.

    Whole texts; a null or empty text gets the score of no features. Rows stay one to one, repeated
    ones included; an empty table gives no rows. A column of docs that has the score's name is replaced;
    see unused() for a name that is free.
    """
    if score == text:
        raise ValueError(f"the score cannot replace the text {text!r}")
    docs = docs.drop(score)
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast((model.shares(), model.odds()))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{score}` double")
