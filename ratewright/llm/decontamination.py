"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is 13 consecutive words of an item. Its shingles are its runs of three words, ordered
by how rare they are in the documents. A window that occurs whole contains all its shingles, so
its rarest one is a sufficient prefix: documents join on it. The shingle's place in the window
gives the place of the window in the document; it has to fit in (positional and length bound),
and then all its words are compared. Few prefixes are broadcast and compared where the document
lies; many are joined by shuffle to the documents' places alone, and each document's candidates
then meet its words once. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import BROADCAST_ROWS, fresh, land, lower_ascii, small, text_key

WINDOW = 13
SHINGLE = 3
#: Fixed value: what separates words once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def shingle_at(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(words, at + i) for i in range(length)))


def windows_of(items: DataFrame) -> DataFrame:
    """``item, window``: the words of each window of each item."""
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - WINDOW + 1))
    return words.select("item", "words", F.explode(starts).alias("start")).select(
        "item", F.slice("words", F.col("start"), F.lit(WINDOW)).alias("window")
    )


def occurrences(texts: DataFrame, length: int) -> DataFrame:
    """``texts`` with a row for each place where a shingle of ``length`` words can start."""
    return (
        texts.select("*", F.posexplode("words").alias("at", "first"))
        .where(F.col("at") + length <= F.col("n_words"))
        .withColumn("shingle", shingle_at(F.col("words"), F.col("at"), length))
    )


def fitting(texts: DataFrame, prefix: DataFrame, length: int, few: bool) -> DataFrame:
    """``doc_id, text_key, id, start, stop`` of every occurrence of a window in ``texts``."""
    start = F.col("at") - F.col("offset")
    inside = (F.col("shingle") == F.col("wanted")) & (start >= 0) & (start + F.col("size") <= F.col("n_words"))

    def here(at: Column, size: Column) -> Column:
        return F.slice("words", at + 1, size)

    if few:
        met = occurrences(texts, length).join(
            F.broadcast(prefix), inside & (here(start, F.col("size")) == F.col("window"))
        )
        return met.select("doc_id", "text_key", "id", start.alias("start"), (start + F.col("size")).alias("stop"))
    places = occurrences(texts, length).select("row", "n_words", "at", "shingle")
    candidates = (
        places.join(prefix, inside)
        .groupBy(F.col("row").alias("of_row"))
        .agg(F.collect_list(F.struct(start.alias("start"), "size", "id", "window")).alias("candidates"))
    )
    met = texts.join(candidates, F.col("row") == F.col("of_row"))
    right = F.filter("candidates", lambda c: here(c["start"], c["size"]) == c["window"])
    return met.select("doc_id", "text_key", F.explode(right).alias("c")).select(
        "doc_id", "text_key", "c.id", "c.start", (F.col("c.start") + F.col("c.size")).alias("stop")
    )


def judge(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each
    row of ``docs``.

    A document word is hit if it lies in any occurrence of a window; an item of fewer than 13
    words is one window. A document is contaminated if at least a twentieth of its words, and at
    least one, are hit. A null or wordless text has no words and is clean; a null or wordless
    item has no window; an item without id is named ``null``. Equal items count by their ids,
    repeated rows of an item once. A repeated document row is judged each time; rows of one
    doc_id and different texts are judged apart. Without items or documents nothing is hit.
    Other columns are ignored.
    """
    texts = land(
        docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words")).select(
            "*", F.size("words").cast("long").alias("n_words"), F.monotonically_increasing_id().alias("row")
        ),
        "document-words",
    )
    named = land(windows_of(items).withColumn("id", F.md5(F.concat_ws(" ", "window"))).distinct(), "windows")
    windows = named.groupBy("id").agg(F.first("window").alias("window")).withColumn("size", F.size("window"))
    # windows of fewer words than a shingle, whole items, are one shingle of their own length
    lengths = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect()]

    hits = None
    for length in lengths:
        mine = windows.where(F.least("size", F.lit(SHINGLE)) == length)
        shingles = mine.select(
            "*", F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("offset")
        ).withColumn("shingle", shingle_at(F.col("window"), F.col("offset"), length))
        wanted = shingles.select(F.col("shingle").alias("wanted")).distinct()
        seen = occurrences(texts.select("words", "n_words"), length)
        rarity = (
            seen.select("shingle").join(small(wanted), F.col("shingle") == F.col("wanted")).groupBy("wanted").count()
        )
        prefix = (
            shingles.join(rarity, F.col("shingle") == F.col("wanted"))  # a shingle no document has: no occurrence
            .groupBy("id")
            .agg(
                F.min(F.struct("count", "shingle", "offset")).alias("rarest"),
                F.count("*").alias("present"),
                F.first("window").alias("window"),
                F.first("size").alias("size"),
            )
            .where(F.col("present") == F.col("size") - length + 1)
            .select("id", "window", "size", F.col("rarest.shingle").alias("wanted"), F.col("rarest.offset").alias("offset"))
        )
        prefix = land(prefix, "prefixes")
        few = prefix.limit(broadcast_rows + 1).count() <= broadcast_rows
        found = fitting(texts, prefix, length, few)
        hits = found if hits is None else hits.union(found)

    base = texts.select("doc_id", "text_key", "n_words")
    none = F.sha2(F.lit("").cast("binary"), 256)
    if hits is None:
        zero = F.lit(0).cast("long")
        return base.select(
            "*", zero.alias("n_hit"), zero.alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated")
        )
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["stop"], s["stop"]).alias("stop"),
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["stop"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    hit = land(
        hits.groupBy("doc_id", "text_key")
        .agg(spans.alias("spans"), F.array_sort(F.collect_set("id")).alias("ids"))
        .select("doc_id", "text_key", covered.alias("n_hit"), "ids", F.md5(F.concat_ws("", "ids")).alias("set")),
        "document-hits",
    )
    # documents with the same windows have the same items: named once for each set of windows
    sets = (
        hit.groupBy("set")
        .agg(F.first("ids").alias("ids"))
        .select("set", F.explode("ids").alias("id"))
        .join(named.select("id", "item"), "id")
        .groupBy("set")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(
            F.col("set").alias("item_set"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        )
    )
    known = hit.join(sets, F.col("set") == F.col("item_set")).select(
        F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"), "n_hit", "n_items", "items_sha256"
    )
    out = base.join(
        known, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    verdicts = judge(docs, items).where("contaminated").select("doc_id", "text_key").distinct()
    doc, key = fresh("doc"), fresh("key")
    bad = verdicts.toDF(doc, key)
    return docs.join(
        small(bad), docs["doc_id"].eqNullSafe(bad[doc]) & (text_key(docs["text"]) == bad[key]), "left_anti"
    )
