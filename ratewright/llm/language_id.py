"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter slot holds a bit for each language, so that looking up an n-gram at its slots and
combining them with AND gives the mask of all languages that may contain it. Per-language
popcounts over a document's n-grams, corrected for each language's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import pieces

#: A language contains an n-gram that makes up at least this share of all its n-grams. So a
#: language has at most 1 / SHARE n-grams, however many texts it is learned from.
SHARE = 1e-5
SLOT_BITS = 20
HASHES = 3
#: Odd multipliers of the filter's hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
UNKNOWN = "und"
#: Texts judged at once; their words take some 20 times as much.
CHUNK_BYTES = 1_000_000

WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Number of words of each text, word numbers of all texts in a row, the distinct words."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = [w for ws in found for w in ws]
    if not flat:
        return sizes, np.empty(0, np.int64), []
    ids, distinct = pd.factorize(np.array(flat, dtype=object))
    return sizes, ids, list(distinct)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each word the code of the trigram around it (a blank stands at
    either end), and the number of letters of each word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    middle = np.flatnonzero(points != 32)
    codes = (points[middle - 1] << 42) | (points[middle] << 21) | points[middle + 1]
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES, "text"):
            langs, names = pd.factorize(np.array(batch.column(1).to_pylist(), dtype=object))
            sizes, ids, words = words_of(batch.column(0).to_pylist())
            if not words:
                continue
            codes, letters = trigrams(words)
            grams, which = np.unique(codes, return_inverse=True)
            owner = np.repeat(np.arange(len(words)), letters)
            per_word = np.repeat(langs, sizes)
            for i, name in enumerate(names):
                often = np.bincount(ids[per_word == i], minlength=len(words))
                n = np.bincount(which, often[owner], len(grams)).astype(np.int64)
                seen = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * int(seen.sum()), pa.string()), pa.array(grams[seen]), pa.array(n[seen])],
                    names=["lang", "gram", "n"],
                )

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters: ``slots[w, s]`` has the bits of languages 64 w and on."""

    def __init__(self, names: list[str], grams: np.ndarray, langs: np.ndarray):
        self.names = names
        self.slots = np.zeros((-(-max(1, len(names)) // 64), 1 << SLOT_BITS), np.uint64)
        for at in self.places(grams):
            np.bitwise_or.at(self.slots, (langs // 64, at), np.uint64(1) << (langs % 64).astype(np.uint64))
        fill = [self.has(self.slots[i // 64], i).mean() for i in range(len(names))]
        self.false = np.array(fill) ** HASHES

    @staticmethod
    def has(masks: np.ndarray, lang: int) -> np.ndarray:
        return (masks >> np.uint64(lang % 64)) & np.uint64(1)

    @staticmethod
    def places(grams: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            mixed = grams.astype(np.uint64)
            mixed ^= mixed >> np.uint64(29)
            return [((mixed * np.uint64(m)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in MULTIPLIERS[:HASHES]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the share of its n-grams that speak for it."""
        sizes, ids, words = words_of(texts)
        hits = np.zeros((len(texts), len(self.names)))
        total = np.zeros(len(texts))
        if words and self.names:
            codes, letters = trigrams(words)
            grams, which = np.unique(codes, return_inverse=True)
            at = self.places(grams)
            starts = np.concatenate([[0], np.cumsum(letters)[:-1]])
            masks = [row[at[0]] & row[at[1]] & row[at[2]] for row in self.slots]
            full, first = sizes > 0, (np.cumsum(sizes) - sizes)
            total[full] = np.add.reduceat(letters[ids], first[full])
            for i in range(len(self.names)):
                of_word = np.add.reduceat(self.has(masks[i // 64], i)[which].astype(np.int64), starts)
                hits[full, i] = np.add.reduceat(of_word[ids], first[full])
        n = np.maximum(total, 1)[:, None]
        true = np.clip((hits / n - self.false) / (1 - np.minimum(self.false, 0.999)), 0, 1)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = true.argmax(axis=1)
        known = sizes > 0
        return (
            [self.names[b] if k else UNKNOWN for b, k in zip(best, known)],
            np.where(known, true[np.arange(len(texts)), best], 0.0),
        )


def learn(docs: DataFrame) -> Filters:
    """Learn from ``text, lang``; rows without either teach nothing. What reaches the driver is
    at most 1 / SHARE n-grams for each language."""
    counts = count_ngrams(docs.where("text IS NOT NULL AND lang IS NOT NULL"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * SHARE)
    found = kept.select("lang", "gram").toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    langs = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
    return Filters(names, found["gram"].to_numpy(), langs)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text``).

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned. Of equally likely languages the first by name is taken. Rows are judged one by
    one: null or repeated doc_ids stay; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES, "text"):
            names, score = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: Filters, least: float) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language, all columns as they are.

    A row goes if its prediction is ``und`` or its score is under ``least``: its text is null,
    has no letter, or is made of n-grams no learned language contains.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    # plain names: the caller's may hold dots
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text = plain[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES, text):
            found, score = shared.value.predict(batch.column(text).to_pylist())
            yield batch.filter(pa.array(np.array([x != UNKNOWN for x in found], bool) & (score >= least)))

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, docs.schema.fields))
    return docs.toDF(*plain).mapInArrow(run, kinds).toDF(*docs.columns)
