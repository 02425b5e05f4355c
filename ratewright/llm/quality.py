"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

A word's vector is the sum of sparse random vectors of the words around it, over all texts.
Words are folded into a fixed number of rows, so the vectors have a fixed size. A document is
the mean vector over its words, the mean over its distinct rows, and two counts. A network of
two layers scores it, and one temperature, fitted on rows the network has not seen, calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import pieces

ROWS, DIMENSIONS, REACH = 1 << 15, 32, 2
NONZERO = 0.25
SEED = 20_240
#: Documents the network is trained on at most; the first by a hash of their id.
TRAINING_DOCUMENTS = 20_000
HIDDEN, EPOCHS, BATCH = 32, 40, 256
THRESHOLD = 0.3
CHUNK_BYTES = 2_000_000
BLOCK = 1024
#: Distinct words a task remembers the rows of.
REMEMBERED = 500_000

WORD = regex.compile(r"\w+|[^\w\s]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Words(dict):
    """Word to row, remembered."""

    def __missing__(self, word: str) -> int:
        row = xxhash.xxh3_64_intdigest(word, SEED) % ROWS
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = row
        return row

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, rows of all words one after another."""
        found = [WORD.findall(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((self[w] for ws in found for w in ws), np.uint16, int(sizes.sum()))
        return sizes, flat


def index_vectors() -> np.ndarray:
    """Sparse vectors of -1, 0 and 1, the same in every task."""
    rng = np.random.default_rng(SEED)
    sign = rng.integers(0, 2, (ROWS, DIMENSIONS), np.int8) * 2 - 1
    return sign * (rng.random((ROWS, DIMENSIONS)) < NONZERO).astype(np.int8)


def add_contexts(sums: np.ndarray, rows: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> None:
    """Add to each row of ``sums`` the index vectors of the words up to REACH away."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for start in range(0, len(rows), 200_000):
        stop = min(len(rows), start + 200_000)
        lo, hi = max(0, start - REACH), min(len(rows), stop + REACH)
        around = np.zeros((stop - start, DIMENSIONS), np.int16)
        part, owner = rows[lo:hi], doc[lo:hi]
        for step in range(-REACH, REACH + 1):
            if step == 0:
                continue
            at = np.arange(start - lo, stop - lo) + step
            inside = (at >= 0) & (at < hi - lo)
            inside[inside] = owner[at[inside]] == doc[start:stop][inside]
            around[inside] += index[part[at[inside]]]
        order = np.argsort(rows[start:stop], kind="stable")
        mine = rows[start:stop][order]
        firsts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        sums[mine[firsts]] += np.add.reduceat(around[order], firsts, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all rows, from every text. Sums are whole numbers: the order of
    adding does not matter. The driver gets ROWS x DIMENSIONS numbers at any input."""
    blocks = ROWS // BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, words, index = np.zeros((ROWS, DIMENSIONS), np.int64), Words(), index_vectors()
        for batch in pieces(batches, CHUNK_BYTES, "text"):
            sizes, rows = words.of(batch.column(0).to_pylist())
            add_contexts(sums, rows, sizes, index)
        shift = int(xxhash.xxh3_64_intdigest(sums.tobytes()) % 64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(blocks), pa.int32()),
                pa.array([shift] * blocks, pa.int32()),
                pa.array([sums[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(blocks)], pa.binary()),
            ],
            names=["block", "lane", "sums"],
        )

    def add(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK * DIMENSIONS, np.int64)
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("sums")):
                total += np.frombuffer(blob.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"]
        )

    parts = docs.where("text IS NOT NULL").select("text").mapInArrow(run, "block int, lane int, sums binary")
    # two steps, so that no task adds up what all tasks of the input made
    lanes = parts.groupBy("block", "lane").applyInArrow(add, "block int, sums binary")
    table = lanes.groupBy("block").applyInArrow(add, "block int, sums binary").collect()
    sums = np.zeros((blocks, BLOCK * DIMENSIONS))
    for row in table:
        sums[row["block"]] = np.frombuffer(row["sums"], np.int64)
    sums = sums.reshape(ROWS, DIMENSIONS)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(length, 1)).astype(np.float32)


def pooled(texts: list[str | None], words: Words, vectors: np.ndarray) -> np.ndarray:
    """What the network sees of each text."""
    sizes, rows = words.of(texts)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2), np.float32)
    first = np.cumsum(sizes) - sizes
    for i, (n, at) in enumerate(zip(sizes, first)):
        if n:
            some = np.bincount(rows[at : at + n], minlength=1)
            distinct = np.flatnonzero(some)
            mine = vectors[distinct]
            out[i, :DIMENSIONS] = some[distinct] @ mine / n
            out[i, DIMENSIONS:-2] = mine.mean(axis=0)
            out[i, -2:] = np.log1p(n), len(distinct) / n
    return out


class Network:
    """Two layers, trained by Adam on the log loss; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        kept = np.arange(len(x)) % 8 != 0
        if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
            kept[:] = True
        self.weights = [
            rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, HIDDEN**-0.5, HIDDEN),
            np.zeros(1),
        ]
        self.temperature = 1.0
        self.train((x[kept] - self.mean) / self.scale, y[kept], rng)
        rest = ~kept if not kept.all() else kept
        logit = self.logit(x[rest])
        choices = np.geomspace(0.25, 8, 101)
        loss = [np.logaddexp(0, -(2 * y[rest] - 1) * logit / t).mean() for t in choices]
        self.temperature = float(choices[int(np.argmin(loss))])

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for start in range(0, len(x), BATCH):
                some = order[start : start + BATCH]
                a, b, c, d = self.weights
                hidden = np.tanh(x[some] @ a + b)
                error = (1 / (1 + np.exp(-(hidden @ c + d))) - y[some]) / len(some)
                back = np.outer(error, c) * (1 - hidden**2)
                slopes = [x[some].T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(slopes):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                    self.weights[i] = self.weights[i] - 3e-3 * move

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


class Constant:
    """Where nothing or only one class was learned."""

    def __init__(self, share: float):
        self.share = share

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``vector``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches, CHUNK_BYTES, "text"):
            x = pooled(batch.column("text").to_pylist(), words, shared.value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(list(x), pa.list_(pa.float32()))], names=[*others, "vector"]
            )

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, vector array<float>")


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = TRAINING_DOCUMENTS):
    """A network from labelled rows that are not held out, at most ``most`` of them.

    Rows with a null doc_id or label teach nothing. A document labelled more than once counts
    once, with its larger label.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = document_vectors(texts, vectors).toArrow()
    if not rows.num_rows:
        return Constant(0.5)
    y = np.array(rows["quality"].to_pylist(), float)
    if len(set(y)) < 2:
        return Constant(float(y[0]))
    x = np.array(rows["vector"].to_pylist(), np.float64)
    # one order whatever the partitions: by document, then by vector where a document repeats
    order = np.lexsort([x[:, 0], pd.util.hash_array(np.array(rows["doc_id"].to_pylist()))])
    return Network(x[order], y[order])


def score(docs: DataFrame, model, vectors: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    A null, empty or blank text is scored as a text of no words. Rows are scored one by one:
    null or repeated doc_ids stay; other columns are ignored; no rows give no rows. With no
    usable label every score is 0.5, with labels of one kind only it is that label.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, table = shared.value
        words = Words()
        for batch in pieces(batches, CHUNK_BYTES, "text"):
            p = network.probability(pooled(batch.column(2).to_pylist(), words, table).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
