"""Spelling variants by composing vocabulary acceptor, one-edit transducer and acceptor again.

Two words that differ by one edit share what stands before and after it. A word is dealt out once
for each window its edit may lie in; words with equal letters outside the window meet. There the
letters before the window lead all of them to one state, the initial one of that partition: its
words' letters inside the window become a minimised acceptor, which is composed with the one-edit
transducer and itself, and the accepted pairs are enumerated. Windows start as the halves of a
word, or as its pieces of 64 letters. A partition of too many words is halved again; a window of one letter holds no more words
than the alphabet allows, so no partition is unbounded and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import land, lower_ascii

#: Words of one partition at most, unless its window is a single letter.
CROWD = 20_000

#: Letters of a first window at most; longer words start with more than two.
WIDEST = 64

KEY = ["size", "low", "high", "head", "tail"]


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, noise: int = 199) -> DataFrame:
    """``word, n``: the letter runs of all texts, A-Z lower-cased, with their number.

    Where ``noise`` divides the unsigned crc32 h of ``<doc_id>:<run>``, the run loses its code
    point h mod length; 0 turns this off. Only words of ``least_length`` code points and
    ``least_count`` occurrences are kept. Null texts have no runs; a null doc_id is written as
    nothing. Shorter runs are left out by the pattern, since no run grows.
    """
    pattern = rf"[a-zÀ-ÿ]{{{least_length},}}"
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(pattern), F.lit(0))).alias("run"),
    )
    word = F.col("run")
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
        at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.pmod("h", F.lit(noise)) == 0, less).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word"))
        .filter(F.length("word") >= least_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_count)
    )


def _dealt(rows: DataFrame, windows: Column) -> DataFrame:
    """One row a word and window ``(low, high)``, with the letters outside it."""
    behind = F.greatest(F.col("size") - F.col("high"), F.lit(0))
    return (
        rows.select("word", "n", "size", F.inline(windows))
        .withColumn("head", F.substring("word", F.lit(1), F.col("low")))
        .withColumn("tail", F.substring("word", F.length("word") - behind + 1, behind))
    )


def _window(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def partitions(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n`` with the key of each partition that the word is in.

    ``size`` is the length of a pair's shorter word, so a word of m letters is dealt out for m and
    m - 1. The last window also holds the edit behind the last letter.
    """
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
    count = F.greatest(F.lit(2), F.ceil(F.col("size") / WIDEST)).cast("int")
    edge = lambda i: F.floor(F.col("size") * i / count)
    last = lambda i: F.when(i == count - 1, F.col("size") + 1).otherwise(edge(i + 1))
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: _window(edge(i), last(i)))
    dealt = _dealt(sized, windows)
    kept = None
    while True:
        dealt = land(dealt, "spelling-windows")
        shorter = F.sum(F.when(length == F.col("size"), 1).otherwise(0)).alias("shorter")
        groups = dealt.groupBy(*KEY).agg(F.count(F.lit(1)).alias("words"), shorter)
        # A partition without two words, or without one of the shorter length, has no pair.
        groups = groups.filter("words > 1 and shorter > 0")
        crowded = (F.col("words") > crowd) & (F.col("high") - F.col("low") > 1)
        groups = land(groups.withColumn("crowded", crowded), "spelling-partitions")
        here = dealt.join(groups, KEY)
        fine = here.filter(~F.col("crowded")).select("word", "n", *KEY)
        kept = fine if kept is None else kept.unionByName(fine)
        if groups.filter("crowded").isEmpty():
            return kept
        middle = F.expr("(low + high) div 2")
        halves = F.array(_window(F.col("low"), middle), _window(middle, F.col("high")))
        dealt = _dealt(
            here.filter("crowded").select("word", "n", "size", halves.alias("halves")), F.col("halves")
        )


class Automaton:
    """Minimised acceptors over one register of states; a state is its arcs and whether it ends."""

    def __init__(self) -> None:
        self.states: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []

    def accept(self, words: list[str]) -> int:
        """The initial state of the minimised acceptor of sorted different words."""
        return self._state(words, 0, len(words), 0)

    def _state(self, words: list[str], start: int, stop: int, depth: int) -> int:
        ends = start < stop and len(words[start]) == depth
        at = start + ends
        arcs = {}
        while at < stop:
            letter, upto = words[at][depth], at + 1
            while upto < stop and words[upto][depth] == letter:
                upto += 1
            arcs[letter] = self._state(words, at, upto, depth + 1)
            at = upto
        key = (ends, *arcs.items())
        if key not in self.states:
            self.states[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(ends)
        return self.states[key]


def accepted(shorter: list[str], longer: list[str], last: bool) -> Iterator[tuple[str, str]]:
    """Pairs of different words (x, y) one edit apart, x of ``shorter``: y of ``shorter`` and
    greater, or y of ``longer``, which are a letter longer. Both lists are sorted. ``last`` tells
    whether the added letter may stand at the end.

    A letter added next to its like could have been added at several places; the transducer adds
    it behind them, so each pair comes once.
    """
    machine = Automaton()
    one, two = machine.accept(shorter), machine.accept(longer)
    arcs, final = machine.arcs, machine.final

    @cache
    def both(p: int, q: int) -> list[str]:
        """What both states accept: the rest of a pair behind its edit."""
        out = [""] if final[p] and final[q] else []
        few, more = (arcs[p], arcs[q]) if len(arcs[p]) <= len(arcs[q]) else (arcs[q], arcs[p])
        for letter, r in few.items():
            if letter in more:
                out += [letter + rest for rest in both(r, more[letter])]
        return out

    def changed(p: int, before: str) -> Iterator[tuple[str, str]]:
        ways = list(arcs[p].items())
        for i, (c, q) in enumerate(ways):
            yield from changed(q, before + c)
            for d, r in ways[i + 1 :]:
                for rest in both(q, r):
                    yield before + c + rest, before + d + rest

    def added(p: int, q: int, before: str) -> Iterator[tuple[str, str]]:
        for d, r in arcs[q].items():
            if d in arcs[p]:
                yield from added(arcs[p][d], r, before + d)
            for rest in both(p, r):
                if rest[:1] != d and (rest or last):
                    yield before + rest, before + d + rest

    yield from changed(one, "")
    yield from added(one, two, "")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words that differ by exactly one inserted, deleted or
    replaced code point, once. ``words`` has ``word, n``, each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}
        found: list[tuple] = []

        def finish() -> None:
            size, low, high, head, tail = key
            inside = {w[len(head) : len(w) - len(tail)]: (w, n) for w, n in members.items()}
            width = size - len(head) - len(tail)
            shorter = sorted(x for x in inside if len(x) == width)
            longer = sorted(x for x in inside if len(x) > width)
            for x, y in accepted(shorter, longer, last=high > size):
                found.append((*inside[x], *inside[y]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 4
            found.clear()
            kinds = [pa.string(), pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "n_a", "b", "n_b"])

        for batch in batches:
            for word, n, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if row != key:
                    if key is not None:
                        finish()
                    key, members = row, {}
                    if len(found) > 50_000:
                        yield flush()
                members[word] = n
        if key is not None:
            finish()
        yield flush()

    dealt = partitions(words, crowd).repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, "a string, n_a long, b string, n_b long")


def _roots(forms: DataFrame, greatest: int, factor: int) -> DataFrame:
    """``word, root``: the end of the chain of forms, by doubling its steps.

    Each form is ``factor`` times as frequent as the word before, so a chain is no longer than the
    logarithm of the greatest count, which gives the number of rounds.
    """
    now = forms.select("word", F.col("form").alias("root"))
    steps = max(1, math.ceil(math.log(max(greatest, 1), factor)))
    for _ in range(math.ceil(math.log2(steps))):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        now = land(now, "spelling-roots")
    return now


def variants(words: DataFrame, factor: int = 5, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``).

    ``form`` is the near word of the largest n, the smallest in code-point order among equals, if
    that n is at least ``factor`` times the word's; else null. ``root`` is the end of the chain of
    forms, the word itself if it has none. An empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than the word, or chains may not end")
    words = land(words.select("word", "n"), "vocabulary")
    pairs = land(near_pairs(words, crowd), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select("b", "a", "n_a")
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    stats = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    holds = -F.col("best.less") >= F.col("n") * factor
    judged = words.join(stats, "word", "left").select(
        "word",
        F.when(holds, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(holds, -F.col("best.less")).alias("form_n"),
    )
    judged = land(judged, "spelling-forms")
    greatest = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(judged.filter("form is not null"), greatest, factor)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
