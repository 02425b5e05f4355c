"""What a Python worker holds at once, whatever the texts."""

import tracemalloc

import numpy as np

from ratewright.llm import language_id, ngram_join
from ratewright.llm.common import pieces


def peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_remembered_by_a_shingler():
    texts = [" ".join(f"w{i}x{k}" for k in range(1000)).encode() for i in range(300)]
    shingler, found = ngram_join.Shingler(), []

    def work():
        with np.errstate(over="ignore"):
            found.extend(shingler.of(t) for t in texts)

    assert peak(work) < 30
    assert len(shingler) <= 100_000 and len(np.unique(np.concatenate(found))) == 300 * 996
    with np.errstate(over="ignore"):  # a forgotten word gets the same hash again
        assert (ngram_join.Shingler().of(texts[0]) == shingler.of(texts[0])).all()


def test_shingles_that_wait_to_be_counted():
    waiting = [np.random.default_rng(1).integers(0, 1 << 63, ngram_join.FLUSH).astype(np.uint64)]
    assert peak(lambda: ngram_join.by_part(waiting, 8)) < 20


def test_texts_judged_at_once():
    import pyarrow as pa

    filters = language_id.Filters(["de", "en"], np.arange(100), np.arange(100) % 2)
    texts = [" ".join(f"wort{'abcdefghij'[(i + k) % 10]}" for k in range(1000)) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = []

    def work():
        for piece in pieces([batch], language_id.CHUNK_BYTES, "text"):
            found.extend(filters.predict(piece.column(0).to_pylist())[0])

    assert peak(work) < 40 and len(found) == 600
