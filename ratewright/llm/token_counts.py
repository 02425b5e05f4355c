"""Token counts by byte-pair merging with a heap over a linked list.

A word's symbols form a doubly linked list; a heap holds the adjacent pairs that can merge,
the lowest rank first. The count is the number of symbols less the merges done; no token is
named. The vocabulary file's path is a parameter; the driver reads it and broadcasts its
merges, whose number the file fixes.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ratewright.llm.common import pieces

#: Distinct words whose counts a task remembers at a time, and the longest it remembers.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64

#: How the byte-level alphabet writes bytes as characters.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> list[str]:
    shown = {b: chr(b) for b in PRINTABLE}
    hidden = [b for b in range(256) if b not in shown]
    return [shown.get(b) or chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """What counting needs of a tokenizer file with word ends."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[left, right] = rank
        self.end = model["end_of_word_suffix"] or ""
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        splits = spec["pre_tokenizer"]["pretokenizers"]
        self.word = regex.compile(splits[0]["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Number of tokens of one word."""
        symbol = [self.alphabet[b] for b in word.encode()]
        symbol[-1] += self.end
        count = len(symbol)
        after = [*range(1, count), -1]
        before = [*range(-1, count - 1)]
        heap = [
            (rank, i, symbol[i], symbol[i + 1])
            for i in range(count - 1)
            if (rank := self.ranks.get((symbol[i], symbol[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # one side has merged since
            symbol[i], symbol[j], after[i] = left + right, "", after[j]
            count -= 1
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    rank = self.ranks.get((symbol[a], symbol[b]))
                    if rank is not None:
                        heapq.heappush(heap, (rank, a, symbol[a], symbol[b]))
        return count

    def of_word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.merged(word)
            if len(word) <= REMEMBERED_LENGTH:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = n
        return n

    def count(self, text: str) -> int:
        """Number of tokens of a text; a special string inside it is one token."""
        special = 0
        parts = [text]
        for token in self.special:
            cut = [x for part in parts for x in part.split(token)]
            special += len(cut) - len(parts)
            parts = cut
        total = special
        for part in parts:
            if part:
                # each character by itself is lower-cased: the last sigma of a word is no exception
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                total += sum(map(self.of_word, self.word.findall(plain)))
        return total


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``vocabulary`` is the path of a tokenizer file on the driver. A null text counts as empty:
    no bytes and no tokens. Null and repeated doc_ids stay as they are, each row is counted by
    itself; other columns are ignored; an empty table gives no rows. Letters that Unicode has
    added since version 15.1 may count otherwise than in a library with older tables.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = None
        for batch in pieces(batches, 8_000_000, "text"):
            merges = merges or Merges(shared.value)
            texts = batch.column(1).to_pylist()
            tokens = [merges.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
