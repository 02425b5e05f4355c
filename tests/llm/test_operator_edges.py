"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import unicodedata

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ratewright.llm import (
    decontamination,
    embedding_dedup,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    quality,
    token_counts,
    url_filters,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id string, `a.b` int"
LONG = " ".join(f"w{i % 7001}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word60", "other")
TEXTS = [
    (1, BASE + "\nshared line of text here"),
    (2, NEAR + "\nShared line of text here"),
    (3, ""),
    (4, None),
    (5, " \n\t\n"),
    (6, LONG),
    (7, "The Question Is What"),
    (8, "*** 1234 ###"),
    (9, BASE + "\nshared line of text here"),
    (None, "a text without an id\nshared line of text here"),
    (10, "<|endoftext|> İstanbul ΣΑΣ l'été don't ²Ⅷ\u00a0x"),
    (10, "<|endoftext|> İstanbul ΣΑΣ l'été don't ²Ⅷ\u00a0x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", None, None, "x", "y", 3) for d, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_packing(docs, none):
    got = rows(packing.pack(docs, max_length=100, buckets=3, budget=300))
    assert rows(packing.pack(none)) == []
    words = [len((t or "").encode().split()) for _, t in TEXTS]
    assert sum(r[2] for r in got) == sum(words) and len(got) == sum(max(1, -(-n // 100)) for n in words)
    held = {}
    for _, _, n, bucket, batch in got:
        assert n <= bucket
        held[bucket, batch] = held.get((bucket, batch), 0) + 1
    assert all(n * max(1, bucket) <= 300 for (bucket, _), n in held.items())
    padding = sum(r[3] - r[2] for r in got)
    assert padding == brute.least_padding([r[2] for r in got], 3)


@pytest.mark.parametrize("buckets", [1, 2, 4, 9])
def test_boundaries_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    lengths = rng.integers(0, 40, 12)
    ends = packing.boundaries(lengths.tolist(), [1] * len(lengths), buckets)
    assert sum(min(e for e in ends if e >= n) - n for n in lengths) == brute.least_padding(lengths.tolist(), buckets)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, " ".join(f"word{i}" for i in range(10, 30))), (1, " ".join(f"word{i}" for i in range(10, 30))),
         (2, "the question"), (None, "question"), (3, None), (4, "..."), (5, "not anywhere")],
        "item_id long, text string",
    )
    got = rows(decontamination.judge(docs, items).drop("text_key"))
    want = brute.contamination(list(enumerate(t for _, t in TEXTS)), [tuple(r) for r in items.collect()])
    assert sorted(map(str, got)) == sorted(str((d, *want[i])) for i, (d, _) in enumerate(TEXTS))
    assert rows(decontamination.judge(none, items)) == []
    assert not any(r[6] for r in rows(decontamination.judge(docs, items.limit(0))))
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and {r[0] for r in rows(clean)} == {3, 4, 5, 6, 8, 10, None}


def test_decontamination_by_shuffle(spark):
    """Beyond what may be broadcast, only places meet windows, not whole documents."""
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"w{n}" for n in rng.integers(0, 400, size))) for i, size in enumerate([0, 5, 30, 400, 6000, 6000])]
    items = [(f"i{i}", " ".join(texts[4][1].split()[a:b])) for i, (a, b) in enumerate([(0, 40), (90, 103), (500, 508), (700, 702), (9, 10)])]
    docs = spark.createDataFrame(texts + [(None, texts[4][1])], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id string, text string")
    got = {r[0]: (r[2], *r[3:]) for r in rows(decontamination.judge(docs, table, broadcast_rows=0))}
    assert got == brute.contamination(texts + [(None, texts[4][1])], items)


def test_url_with_very_many_labels(spark):
    """A host's expressions are bounded by the rules' shapes."""
    rules = spark.createDataFrame(brute.RULES + [("a.b.net", "/", "block")], "host string, path string, verdict string")
    hosts = ["x." * 20_000 + "a.b.net", "x." * 20_000 + "example.com", ".net", "net.", "." * 9, "b.net", "xnet"]
    urls = spark.createDataFrame([(i, f"http://{h}/en/x") for i, h in enumerate(hosts)], "key long, url string")
    got = {r[0]: (r[4], r[5]) for r in rows(url_filters.judge(urls, rules))}
    listed = brute.RULES + [("a.b.net", "/", "block")]
    assert got == {i: brute.url_verdict(f"http://{h}/en/x", listed)[2:] for i, h in enumerate(hosts)}
    joins = url_filters.judge(urls, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Join [short_hash" in joins and "rule_digest" not in joins.split("Join [short_hash")[1].split("]")[1][:80]


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q", "http://example.com/en",
            "https://a.b.net/fr/?x#y", "http://net/es/a/b", "http://example.com", "x://y://z/", "http://example.com/en/"]
    table = spark.createDataFrame([(i % 9, u, 1) for i, u in enumerate([*urls, *urls])], "key long, url string, host int")
    rules = spark.createDataFrame([*brute.RULES, ("com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = rows(url_filters.judge(table, rules))
    want = [(r[0], r[1], *brute.url_verdict(r[1])) for r in rows(table)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert rows(url_filters.judge(table.limit(0), rules)) == []
    assert {r[5] for r in rows(url_filters.judge(table, rules.limit(0)))} == {"allow"}


def test_line_dedup(docs, none):
    got = rows(line_dedup.removed_lines(docs))
    named = [(i if d is None else 10 * d + i % 2, t) for i, (d, t) in enumerate(TEXTS) if d is not None]
    assert len(got) == len(TEXTS)
    by = {(r[0], r[2]): r[3] for r in got}
    assert by[None, 2] == []  # a null id comes first
    assert by[1, 2] == [1] and by[2, 2] == [0, 1] and by[9, 2] == [0, 1] and by[4, 0] == [] and by[5, 3] == []
    assert named and [r[3] for r in got if r[0] == 10] == [[], []]
    cleaned = line_dedup.remove(docs)
    assert cleaned.columns == docs.columns
    texts = {r[0]: r[1] for r in rows(cleaned)}
    assert texts[9] == "" and texts[1] == BASE and texts[4] is None and len(rows(cleaned)) == len(TEXTS)
    assert rows(line_dedup.removed_lines(none)) == [] and rows(line_dedup.remove(none)) == []


def test_line_keys_tell_rare_words(spark):
    """Words of one line come before words of two lines, with more words than a coarse count tells."""
    lines = [" ".join([*(f"one{i}x{k}" for k in range(10)), *(f"two{i // 2}x{k}" for k in range(10))]) for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    classes = F.lit(line_dedup.bucket_classes(docs))
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    kind = {r[1][0]: r[0][:3] for r in words.select("word", line_dedup.keys_of(F.col("word"), classes)).collect()}
    keys = [r[0] for r in docs.select(line_dedup.keys_of(F.col("text"), classes)).collect()]
    assert {len(k) for k in keys} == {20} and len(kind) == 15_000
    assert sum(kind[k] == "one" for some in keys for k in some[:10]) > 0.8 * 10_000


def test_line_keys_hold_no_null(spark):
    """Spark sorts a list of numbers without boxing them only if it knows that none is null."""
    docs = spark.createDataFrame([(1, "b a c a")], "doc_id long, text string")
    keys = docs.select(line_dedup.keys_of(F.col("text"), F.lit(line_dedup.bucket_classes(docs))).alias("keys"))
    assert not keys.schema["keys"].dataType.containsNull and len(keys.first()[0]) == 3


def test_line_dedup_at_the_widths_of_sketches(spark):
    """Pairs just at and just below 0.8, with sketches of the same and of different widths."""
    texts = []
    for n in (50, 64, 72, 80, 190, 200, 240, 400):
        line = [f"v{n}x{i}" for i in range(n)]
        least = -(-4 * n // 5)
        swapped = n // 9
        other = [f"u{n}x{i}" for i in range(swapped + 1)]
        for variant in (line, line[:least], line[: least - 1], line[swapped:] + other[:swapped], line[swapped + 1 :] + other):
            texts.append((len(texts), " ".join(variant)))
    got = rows(line_dedup.removed_lines(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {r[0]: (r[2], r[3]) for r in got} == brute.removed_lines(texts)
    assert 0 < sum(len(r[3]) for r in got) < len(texts)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    vectors = quality.word_vectors(docs)
    got = rows(quality.score(docs, quality.fit(docs, labels, vectors), vectors))
    assert len(got) == len(TEXTS) and all(0 <= r[2] <= 1 for r in got)
    empty = quality.word_vectors(none)
    assert not empty.any() and rows(quality.score(none, quality.fit(none, labels, empty), empty)) == []


def test_warc(spark, tmp_path):
    big = "é" * 90_000
    pages = [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "x" * 999),
             (6, "u", "x" * 999), (2, None, big), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 90)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    got = rows(warc.round_trip(table).select("page_id", "payload_bytes", "record_type", "refers_to", "complete"))
    want = [(p, len((h or "").encode()), "revisit" if p in (1, None) else "response", 2 if p in (1, None) else None, True) for p, _, h in pages]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert rows(warc.round_trip(table.limit(0))) == []
    assert warc.dechunked(warc.chunked(big.encode())) == big.encode()


def test_broken_segments(spark, tmp_path):
    import gzip

    records = list(warc.records("urn:page:1:x", "u", b"z" * 200_000, None))
    path = tmp_path / "archive"
    path.mkdir()
    for name, some in (("whole", records[::-1]), ("short", records[:-1]), ("gap", records[:1] + records[2:])):
        folder = path / name
        folder.mkdir()
        (folder / "part-0.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in some)))
        (row,) = warc.read_archives(spark, str(folder)).collect()
        assert row["whole"] == (name == "whole") and row["size"] == (200_000 if name == "whole" else None)


def test_language_id(docs, none):
    got = {r[0]: r for r in rows(language_id.identify(docs, language_id.learn(docs)))}
    assert all(got[i][2:] == ("und", 0.0) for i in (3, 4, 5, 8)) and got[1][2] == "en"
    nothing = language_id.learn(none)
    assert all(r[2] == "und" for r in rows(language_id.identify(docs, nothing)))
    assert rows(language_id.identify(none, nothing)) == []
    kept = language_id.keep_identified(docs, language_id.learn(docs), 0.5)
    assert kept.columns == docs.columns and {r[0] for r in rows(kept)} == {1, 2, 6, 7, 9, 10, None}


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [(d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in TEXTS]
    assert sorted(map(str, ((r[0], r[2]) for r in rows(token_counts.count_tokens(docs, path))))) == sorted(map(str, want))
    assert rows(token_counts.count_tokens(none, path)) == []
    merges = token_counts.Merges(open(path, encoding="utf-8").read())
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}B" for c in range(start, start + 64) if unicodedata.category(chr(c)) not in ("Cn", "Cs"))
        assert merges.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(start)


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    near = base[:20] + rng.normal(scale=0.12, size=(20, 8))
    vectors = [*base.tolist(), *near.tolist(), base[0].tolist(), (base[0] * 3).tolist(), [0.0] * 8, None, [], [1.0, None],
               [float("nan")] * 8, [1e308] * 8, [1.0, 2.0], [1.0, 2.0]]
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, h1 string")
    got = {r[0]: r[1:] for r in rows(embedding_dedup.near_duplicates(table, tile=16))}
    want = brute.embedding_groups([(i, v) for i, v in enumerate(vectors) if v != [1e308] * 8])
    want[vectors.index([1e308] * 8)] = got[vectors.index([1e308] * 8)][:2]
    assert {i: r[:2] for i, r in got.items()} == want and len(got) == len(vectors)
    assert rows(embedding_dedup.near_duplicates(table.limit(0))) == []
    ids = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.1]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(map(str, rows(embedding_dedup.near_duplicates(ids)))) == sorted(
        map(str, [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True)])
    )


def test_ngram_join(docs, none):
    got = rows(ngram_join.group(docs))
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(TEXTS) and by[1][1] == by[2][1] == by[9][1] == 1 and by[3] == (0, 3) and by[7] == (1, 7)
    want = brute.groups([(i, t) for i, (_, t) in enumerate(TEXTS)])
    assert by[6][0] == want[5][0] and by[1][0] == want[0][0]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r[0]) for r in rows(kept)) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 10, None]))
    assert rows(ngram_join.group(none)) == [] and rows(ngram_join.keep_one(none)) == []


def test_tree_equals_counting():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.95], rng.integers(0, 1 << 60, 20).astype(np.uint64)])) for _ in range(40)]
    sizes = [len(s) for s in sets]
    tree = ngram_join.Tree(sets, sizes)
    for probe in sets:
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(s, probe)) >= ngram_join.least_overlap(len(s), len(probe))]
        assert sorted(tree.similar(probe, len(probe))) == want


def test_the_order_knows_every_shared_shingle(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[50:300]), "a text of seven words that is alone", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    order = ngram_join.global_order(docs)
    with np.errstate(over="ignore"):
        whole, part, alone = (ngram_join.Shingler().of(texts[i].encode()) for i in range(3))
    shared = np.intersect1d(whole, part)
    assert len(shared) == 246 and order.in_several(shared).all()
    assert not order.in_several(np.concatenate([np.setdiff1d(whole, shared), alone])).any()
    assert (order.common(whole) == shared).all()


def test_places_follow_the_hash():
    hashes = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 100_000, dtype=np.uint64))
    edges = np.array([0, (1 << 62) - 1, 1 << 62, (1 << 64) - 1], np.uint64)
    for grain in (ngram_join.SHARED_GRAIN, ngram_join.FREQUENT_GRAIN):
        places = ngram_join.Order.place(np.sort(np.concatenate([hashes, edges])), grain)
        assert (np.diff(places) >= 0).all() and places[0] == 0
        first, last = ngram_join.Order.place(edges[1:3], grain)
        assert last == first + 1 == (1 << ngram_join.MAP_BITS) >> grain


def test_long_vectors_are_multiplied_exactly():
    """Pairs just at the threshold, in more dimensions than float32 sums hold."""
    rng = np.random.default_rng(9)
    size = 20_000
    x = rng.choice([-1.0, 1.0], (24, size)) + rng.normal(0, 0.01, (24, size))
    y = x + rng.normal(0, 0.48, x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    cosine = x @ y.T
    threshold = float(np.median(np.diag(cosine)))
    found = {(int(i), int(j)) for a, b in embedding_dedup.linked(x, y, threshold, False) for i, j in zip(a, b)}
    exact = np.einsum("ik,jk->ij", x, y)
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(exact >= threshold))} and found
