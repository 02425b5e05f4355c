"""The registered queries over whole tables against plain definitions."""

import hashlib
import os

import brute
import duckdb
import pytest

from ratewright.llm.queries import QUERIES

FOLDER = os.environ.get("LLM_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    return lambda sql: con.execute(sql.replace("$", FOLDER)).fetchall()


def result(spark, name):
    df = QUERIES[name](spark, FOLDER)
    return df, [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(rows):
    return rows("select doc_id, text from '$/documents.parquet'")


def test_decontamination(spark, rows, texts):
    df, got = result(spark, "op2_decontamination")
    assert df.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute.contamination(texts, rows("select item_id, text from '$/benchmark.parquet'"))
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(texts)


def test_url_filters(spark, rows):
    _, got = result(spark, "op3_url_filters")
    want = {p: brute.url_verdict(u) for p, u in rows("select page_id, url from '$/pages.parquet'")}
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(want)


def test_line_dedup(spark, texts):
    _, got = result(spark, "op4_line_dedup")
    want = {}
    for doc, (n, gone) in brute.removed_lines(texts).items():
        want[doc] = (n, len(gone), hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest())
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(texts)


def test_quality(spark, rows):
    _, got = result(spark, "op5_quality")
    labels = dict(rows("select doc_id, quality from '$/labels.parquet'"))
    assert all(r[1] == brute.held_out(r[0], 5, 0) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.3) for r in got)
    held = [(r[2], r[3], labels[r[0]]) for r in got if r[1] and r[0] in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    # Rows never trained on; always answering 1 would give an AUC of 0.5 and the base rate's Brier score.
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / max(1, len(good) * len(bad))
    base = len(good) / len(held)
    brier = sum((s - y) ** 2 for s, _, y in held) / len(held)
    assert good and (not bad or auc >= 0.9) and brier <= max(0.6 * base * (1 - base), 0.05)


def test_warc(spark, rows):
    _, got = result(spark, "op6_warc")
    want = brute.pages(rows("select page_id, html from '$/pages.parquet'"))
    assert {r[0]: r[1:5] for r in got} == want and len(got) == len(want) and all(r[5] for r in got)


def test_language_id(spark, rows):
    _, got = result(spark, "op7_language_id")
    langs = dict(rows("select doc_id, lang from '$/documents.parquet'"))
    assert all(r[1] == brute.held_out(r[0], 4, 2) and 0 <= r[3] <= 1 for r in got)
    held = [r for r in got if r[1] and langs[r[0]] is not None]
    assert sum(r[2] == langs[r[0]] for r in held) >= 0.95 * len(held)


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, got = result(spark, "op8_token_counts")
    want = {}
    for doc, text in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[doc] = (len((text or "").encode()), n, n > 2048)
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(texts)


def test_embedding_dedup(spark, rows):
    _, got = result(spark, "op9_embedding_dedup")
    want = brute.embedding_groups(rows("select vec_id, embedding from '$/embeddings.parquet'"))
    assert {r[0]: r[1:3] for r in got} == want
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_ngram_join(spark, texts):
    _, got = result(spark, "op10_ngram_join")
    assert {r[0]: r[1:] for r in got} == brute.groups(texts) and len(got) == len(texts)


def test_alignment(spark, texts):
    _, got = result(spark, "op11_alignment")
    want = {}
    for doc, (*counts, groups) in brute.alignment(texts).items():
        want[doc] = (*counts, hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(texts)


def test_spelling(spark, texts):
    _, got = result(spark, "op12_spelling")
    assert {r[0]: r[1:] for r in got} == brute.spelling(texts) and len(got) == len({r[0] for r in got})


def test_token_files(spark, texts):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, got = result(spark, "op13_token_files")
    start, want = 0, {}
    for doc, text in sorted(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(texts)


def test_sql(spark):
    """Where there is SQL, it returns the query's rows."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from oracle_check import compare, connect

    from ratewright.llm.oracle import ORACLE

    nullable = ["refers_to", "form_n"]

    def shown(name):
        return lambda *at: (df := QUERIES[name](*at)).withColumns(
            {c: df[c].cast("double") for c in nullable if c in df.columns}
        )

    con = connect(FOLDER)
    assert {name: compare(spark, con, FOLDER, shown(name), sql) for name, sql in ORACLE.items()} == dict.fromkeys(ORACLE, "")
