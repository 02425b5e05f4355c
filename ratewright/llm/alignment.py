"""Alignment of two tokenizers' tokens over the bytes of each document.

Both tokenizers cut the same bytes. Within a batch, two tables of token starts keyed by document
are joined as-of: each token's start finds the other side's token that covers it. The union of
both directions holds every overlapping pair once; byte offsets where tokens of both sides end
cut a document into groups. How many documents hold a pair linked is counted over the corpus and
joined back to each document's links.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.byte_bpe import ByteBpe, loaded
from ratewright.llm.common import fresh, land, pieces

#: Pairs of the greatest counts that are broadcast, at most; the rarer ones are joined by shuffle.
FREQUENT = 1 << 19

BATCH_BYTES = 2_000_000
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class PieceModel:
    """A sentencepiece file: ids of texts, and the bytes of each id."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            one = _BYTE.fullmatch(piece)
            out.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
        return out


class Side:
    """Token bytes and lengths of one tokenizer, and its ids as digits with a mark behind."""

    def __init__(self, token_bytes: list[bytes], closing: bytes):
        self.bytes = token_bytes
        self.length = np.array([len(b) for b in token_bytes], np.int64)
        shown = [str(i).encode() + mark for mark in (b",", closing) for i in range(len(token_bytes))]
        self.shown = np.array(shown, object)

    def spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join([self.bytes[i] for i in ids]) == text

    def tokens(self, ids: list[np.ndarray], name: str) -> pd.DataFrame:
        """One row a token in text order: doc, start, id and index. Documents lie one behind the
        other, so starts rise over the whole batch, as an as-of join asks."""
        flat = np.concatenate([np.array([], np.int64), *ids])
        size = self.length[flat]
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        index = np.arange(len(flat))
        return pd.DataFrame({"doc": doc, "start": np.cumsum(size) - size, name: flat, f"{name}_index": index})


@functools.lru_cache(maxsize=1)
def sides(byte_file: str, piece_file: bytes) -> tuple[ByteBpe, PieceModel, Side, Side]:
    """Both tokenizers of two files' contents; a worker keeps them from task to task."""
    bpe, model = loaded(byte_file, False), PieceModel(piece_file)
    return bpe, model, Side(bpe.token_bytes(), b"|"), Side(model.token_bytes(), b";")


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``doc, a, b`` of every pair of tokens whose bytes overlap.

    A token of one side covers the start of any token it overlaps, or the other way round; equal
    starts are found from both sides and taken from the first.
    """
    forth = pd.merge_asof(a, b.assign(b_start=b["start"]), on="start", by="doc")
    back = pd.merge_asof(b, a.assign(a_start=a["start"]), on="start", by="doc")
    back = back[back["a_start"] < back["start"]]
    return pd.concat([forth[["doc", "a", "b"]], back[["doc", "a", "b"]]])


def grouped(side_a: Side, side_b: Side, a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups a document, and all groups of the batch in order as pieces ``id,`` ``id|`` ``id;``,
    with the number of pieces of each document."""
    end_a = a["start"].to_numpy() + side_a.length[a["a"]]
    end_b = b["start"].to_numpy() + side_b.length[b["b"]]
    last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto_a = np.cumsum(np.bincount(group_a))
    upto_b = np.cumsum(np.bincount(group_b))
    shown = np.empty(len(a) + len(b), object)
    before_b = np.append(0, upto_b)
    shown[np.arange(len(a)) + before_b[group_a]] = side_a.shown[a["a"] + last_a * len(side_a.bytes)]
    shown[np.arange(len(b)) + upto_a[group_b]] = side_b.shown[b["b"] + last_b * len(side_b.bytes)]
    doc_a, doc_b = a["doc"].to_numpy(), b["doc"].to_numpy()
    docs = int(doc_a[-1]) + 1
    return (
        np.bincount(doc_a, last_a, docs).astype(np.int64),
        shown,
        np.bincount(doc_a, minlength=docs) + np.bincount(doc_b, minlength=docs),
    )


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` for every row of ``docs``.

    Tokens A are those of a space and the text by the byte-level file, special strings being plain
    text; tokens B those of the text by the sentencepiece file, which puts a space before it.
    ``groups`` writes both sides' ids group by group, ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is
    the SHA-256 of that instead. ``pairs`` are the different linked id pairs, ``a * size of B + b``,
    ascending, and ``times`` how often each is linked in this document.

    A text that is null or empty, or whose tokens of one side do not spell a space and the text,
    has no tokens: zeros, '' and empty lists. Null and repeated doc_ids keep a row each, other
    columns are ignored, an empty table gives no rows. A batch holds two million bytes of text or
    one text.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_vocabulary, encoding="utf-8") as f:
        file_a = context.broadcast(f.read())
    with open(piece_model, "rb") as f:
        file_b = context.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, model, side_a, side_b = sides(file_a.value, file_b.value)
        for batch in pieces(batches, BATCH_BYTES, "text"):
            texts = batch.column(1).to_pylist()
            filled = [i for i, t in enumerate(texts) if t]
            good, ids_a, ids_b = [], [], []
            for i, ids in zip(filled, model.encode([texts[i] for i in filled])):
                spaced = " " + texts[i]
                first = bpe.encode(spaced)
                if side_a.spells(first.tolist(), spaced.encode()) and side_b.spells(ids, spaced.encode()):
                    good.append(i)
                    ids_a.append(first.astype(np.int64))
                    ids_b.append(np.array(ids, np.int64))
            rows = batch.num_rows
            count = {name: np.zeros(rows, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
            groups = [""] * rows
            pairs = times = np.array([], np.int64)
            if good:
                a, b = side_a.tokens(ids_a, "a"), side_b.tokens(ids_b, "b")
                links = overlaps(a, b)
                whole = len(side_a.bytes) * len(side_b.bytes)
                keys, often = np.unique(
                    links["doc"].to_numpy() * whole + links["a"].to_numpy() * len(side_b.bytes) + links["b"].to_numpy(),
                    return_counts=True,
                )
                pairs, times = keys % whole, often
                n_groups, shown, sizes = grouped(side_a, side_b, a, b)
                start = 0
                for i, n in zip(good, sizes.tolist()):
                    text = b"".join(shown[start : start + n].tolist())[:-1]
                    groups[i] = hashlib.sha256(text).hexdigest() if digest else text.decode()
                    start += n
                count["n_a"][good] = [len(x) for x in ids_a]
                count["n_b"][good] = [len(x) for x in ids_b]
                count["n_groups"][good] = n_groups
                count["n_links"][good] = np.bincount(links["doc"], minlength=len(good))
                count["n_pairs"][good] = np.bincount(keys // whole, minlength=len(good))
            ends = pa.array(np.append(0, np.cumsum(count.pop("n_pairs"))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c) for c in count.values()],
                    pa.array(groups, pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(pairs)),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                ],
                names=["doc_id", *count, "groups", "pairs", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string,"
        " pairs array<long>, times array<int>",
    )


def piece_count(piece_model: str) -> int:
    with open(piece_model, "rb") as f:
        return PieceModel(f.read()).model.get_piece_size()


def pair_counts(aligned: DataFrame, pieces_of_b: int) -> DataFrame:
    """``pair, n_docs, best`` over all rows of ``align``: in how many documents a pair is linked,
    and whether that is the most of its A id. An A id has at most as many pairs as B has ids, so
    its pairs fit in one task."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    first = F.expr(f"pair div {pieces_of_b}").alias("first")
    counted = land(counted.select("pair", "n_docs", first), "pair-counts")
    most = counted.groupBy("first").agg(F.max("n_docs").alias("most"))
    return counted.join(most, "first").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, most: int = FREQUENT) -> int:
    """The least power of two that at most ``most`` pairs' counts reach."""
    power = F.floor(F.log2("n_docs")).cast("int").alias("power")
    held = {r["power"]: r["count"] for r in counts.groupBy(power).count().collect()}
    cut = max(held, default=-1) + 1
    while cut > 0 and most >= held.get(cut - 1, 0):
        cut -= 1
        most -= held.get(cut, 0)
    return 1 << cut


def with_link_counts(rows: DataFrame, row: str, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Add ``n_best``, the links whose pair is the most widespread of its A id, and ``count_sum``,
    the pairs' counts added up over the links. Both tables must be landed ones; the column ``row``
    tells the rows apart and is dropped.

    Frequent pairs, at most ``frequent``, are broadcast, so none is a hot key of a shuffle; the
    links of all rarer pairs are joined by shuffle.
    """
    least = frequent_from(counts, frequent)
    common = F.broadcast(counts.filter(F.col("n_docs") >= least))
    links = rows.select(row, F.inline(F.arrays_zip("pairs", "times")))
    sums = [
        F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n_docs") * F.col("times")).alias("count_sum"),
    ]
    # Summed up on each side before the two meet: rows of a document lie together.
    near = links.join(common, links["pairs"] == common["pair"]).groupBy(row).agg(*sums)
    if least > 1:
        rare = links.join(common, links["pairs"] == common["pair"], "left_anti").join(
            counts.filter(F.col("n_docs") < least).withColumnRenamed("pair", "pairs"), "pairs"
        )
        near = near.unionByName(rare.groupBy(row).agg(*sums))
        near = near.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return rows.join(near, row, "left").withColumns(zero).drop(row)


def align_with_counts(docs: DataFrame, byte_vocabulary: str, piece_model: str, digest: bool = False) -> DataFrame:
    """``align`` and the links' counts over the corpus, in one table a document."""
    row = fresh("row")
    found = align(docs, byte_vocabulary, piece_model, digest).withColumn(row, F.monotonically_increasing_id())
    aligned = land(found, "aligned")
    counts = land(pair_counts(aligned, piece_count(piece_model)), "pairs")
    return with_link_counts(aligned, row, counts)
