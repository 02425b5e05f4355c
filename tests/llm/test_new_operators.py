"""Edges of alignment, spelling variants and token files."""

import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ratewright.llm import alignment, spelling, token_files
from ratewright.llm.byte_bpe import ByteBpe
from ratewright.session import new_shared_path

DOCS = "doc_id long, text string, lang string, n string, pair int, row int, part int, start int, `a.b` int"
LONG = " ".join(f"w{i % 7001}é" for i in range(30_000))
TEXTS = [
    (1, "A text with <|endoftext|> inside, don't  stop\n\n now\t."),
    (2, "naïve café — “quoted” … 42 3rd x²"),
    (3, ""),
    (4, None),
    (5, " \n\t\n"),
    (6, LONG),
    (7, "汉字 и кириллица 🙂\u00a0\u2003\u0085 ｆｕｌｌ"),
    (8, "a\u2581b <0x41> <unk> <s>"),
    (None, "a text without an id"),
    (9, "repeated row"),
    (9, "repeated row"),
    (9, "another text of the same id"),
    (10, "x" * 30_000),
]
A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "x", 1, 2, 3, 4, 5) for d, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_the_librarys(library, special):
    with open(A, encoding="utf-8") as f:
        bpe = ByteBpe(f.read(), special)
    library.encode_special_tokens = not special
    for text in [t for _, t in TEXTS if t] + [" ", "  a", "'S 's I'll", "a\r\nb", "¼ª×÷Ʀ"]:
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]
    library.encode_special_tokens = False


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_many_texts_encode_each_word_once(library, monkeypatch, kind):
    texts = [t for _, t in TEXTS] + ["", None, " a", "a ", "a  b", "a \nb", "a\n b", "x\ty z", "it's 3rd, 4.5 ÿ", "'s 'll",
             "don't. stop' 'll", "ab3 4c 5! a.b. c..", "a ª", "   ", "a b\n", "a b.\nc d"]
    with open(A, encoding="utf-8") as f:
        bpe = ByteBpe(f.read(), True)
    met, of_words = [], bpe.of_words
    monkeypatch.setattr(bpe, "of_words", lambda words: of_words(met.extend(words) or words))
    ends, ids = bpe.encode_all(pa.array([None, *texts], kind).slice(1), 7)
    want = [(library.encode(t, add_special_tokens=False).ids if t else []) + [7] for t in texts]
    assert [x.tolist() for x in np.split(ids.to_numpy(), ends[:-1])] == want
    assert len(met) == len(set(met)) and {"b\n", "3rd,", "ÿ"} < set(met)
    assert bpe.encode_all(pa.array([None, ""], kind))[0].tolist() == [0, 0]
    assert bpe.encode_all(pa.array([], kind), 7)[0].tolist() == []


def test_alignment_equals_all_pairs(docs, none):
    got = rows(alignment.align_with_counts(docs, A, B).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))
    # every row is a document of its own, so that repeated ids do not matter
    want = brute.alignment(list(enumerate(t for _, t in TEXTS)))
    ids = dict(enumerate(d for d, _ in TEXTS))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted([(ids[i], *w) for i, w in want.items()], key=key)
    assert rows(alignment.align_with_counts(none, A, B)) == []


def test_alignment_of_rare_pairs_is_joined(spark, docs):
    plain = alignment.align_with_counts(docs, A, B, digest=True).drop("pairs", "times")
    aligned = alignment.align(docs, A, B, digest=True).withColumn("line", F.monotonically_increasing_id())
    aligned = alignment.land(aligned, "test-aligned")
    counts = alignment.land(alignment.pair_counts(aligned, alignment.piece_count(B)), "test-counts")
    assert alignment.frequent_from(counts, 3) > 1
    split = alignment.with_link_counts(aligned, "line", counts, frequent=3).drop("pairs", "times")
    assert sorted(map(str, rows(split))) == sorted(map(str, rows(plain)))


def variants(spark, counted, **options):
    words = spark.createDataFrame(list(counted.items()), "word string, n long")
    return {r[0]: r[1:] for r in rows(spelling.variants(words, **options))}


def test_variants_of_dense_words(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), size)): int(n) for size in (6, 7, 8) for n in 10 ** rng.uniform(0.7, 5, 250)}
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaab": 125, "baaaaaa": 625, "ab" * 40: 9, "ab" * 40 + "a": 50}
    want = brute.spelling_of(words)
    assert variants(spark, words) == want
    # partitions that are split again and again find the same pairs
    assert variants(spark, words, crowd=4) == want


def test_vocabulary(spark, none):
    long_run = "Qz" * 15_000
    texts = [(i, "Façade FAÇADE façades x×y÷zab " + long_run) for i in range(6)] + [(None, None), (7, ""), (None, "façade")]
    docs = spark.createDataFrame([(d, t, "en", "x", 1, 2, 3, 4, 5) for d, t in texts], DOCS)
    found = spelling.variants(spelling.vocabulary(docs))
    assert {r[0]: r[1:] for r in rows(found)} == brute.spelling(texts)
    assert rows(spelling.variants(spelling.vocabulary(none))) == []


def expected(library, texts, end):
    start, out = 0, []
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
        out.append((doc, start, ids))
        start += len(ids)
    return out


def test_token_files(spark, docs, none, library):
    path = new_shared_path(spark, "test-tokens")
    token_files.write(docs, A, path, files=4, page_rows=2)
    got = sorted(rows(token_files.read(spark, path)), key=lambda r: r[1])
    ids = sorted(range(len(TEXTS)), key=lambda i: (TEXTS[i][0] is not None, TEXTS[i][0] or 0))
    # rows of one id may come in any order, each with the start that its place gives
    assert [r[0] for r in got] == [TEXTS[i][0] for i in ids]
    texts = {}
    for d, t in TEXTS:
        texts.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    at = 0
    for doc, start, n, tokens in got:
        assert start == at and n == len(tokens)
        texts[doc].remove(tokens)
        at += n
    whole = [t for r in got for t in r[3]]
    for first, last in [(0, at), (1, 2), (50, 5000), (at - 3, at + 9), (at, at + 1), (7, 7)]:
        span = sorted(rows(token_files.read_span(spark, path, first, last)), key=lambda r: r[1])
        assert [t for r in span for t in r[2]] == whole[first:last]
        assert not span or span[0][1] == max(first, 0)
    digests = {r[1:] for r in rows(token_files.digests(spark, path)) if r[2]}
    assert digests == {(s, n, zlib.crc32(np.array(t, "<u4").tobytes())) for _, s, n, t in got}


def test_token_files_without_end_or_rows(spark, docs, none, library):
    path = new_shared_path(spark, "test-tokens")
    token_files.write(none, A, path)
    assert rows(token_files.read(spark, path)) == [] == rows(token_files.digests(spark, path))
    assert rows(token_files.read_span(spark, path, 0, 10)) == []
    path = new_shared_path(spark, "test-tokens")
    few = docs.filter("doc_id in (1, 3, 4)")
    token_files.write(few, A, path, end=None)
    got = sorted(rows(token_files.read(spark, path)))
    assert [(r[0], r[1], r[3]) for r in got] == expected(library, [(1, TEXTS[0][1]), (3, ""), (4, None)], None)


def test_token_file_layout(spark, docs):
    """Dictionary for ids, delta for the rest, small pages with an index, several row groups."""
    path = new_shared_path(spark, "test-tokens")
    many = docs.filter("doc_id in (1, 2)").withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    token_files.write(many, A, path, files=1, row_group_bytes=20_000, page_rows=50)
    import glob

    file = pq.ParquetFile(glob.glob(f"{path.removeprefix('file:')}/data/*.parquet")[0])
    assert file.metadata.num_row_groups > 1
    columns = [file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)]
    by_name = {c.path_in_schema: c for c in columns}
    assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in by_name["place"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns if "list" not in c.path_in_schema)
    # metadata alone reads no ids, and a filter on the id reaches the scan
    plan = token_files.read(spark, path).filter("doc_id = 7").select("doc_id", "start", "n_tokens")
    text = plan._jdf.queryExecution().toString()
    assert "ids:array" not in text.split("== Physical Plan ==")[1] and "EqualTo(doc_id,7)" in text
