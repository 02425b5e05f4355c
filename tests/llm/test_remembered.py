"""Pieces of text that a worker has met."""

from ratewright.llm import byte_bpe


class Counting:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, word):
        self.asked.append(word)
        return self.model.tokenize(word)


def test_pieces_in_use_are_kept_when_others_are_forgotten(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        bpe = byte_bpe.ByteBpe(f.read(), True)
    bpe.model = Counting(bpe.model)
    texts = [f"always new{chr(97 + i)}" for i in range(12)]
    found = [bpe.encode(text).tolist() for text in texts]
    assert found == [bpe.library.encode(text, add_special_tokens=False).ids for text in texts]
    assert bpe.model.asked.count("always") == 1 and len(bpe.model.asked) == 13
    assert len(bpe.known) + len(bpe.older) <= 6
