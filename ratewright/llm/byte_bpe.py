"""Token ids of whole texts by a byte-level vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import array
import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ratewright.llm.token_counts import byte_alphabet

#: New pieces after which a worker forgets those it has not met since as many before, and the
#: longest it remembers.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 48

#: Characters on whose classes every Unicode version and pattern library agrees: ASCII's printable
#: ones, tab and line ends, the Latin letters up to U+024F, and dashes, quotes and dots from
#: U+2010 to U+2027.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNCOMMON = re.compile(f"[^\t\n\r\x20-\x7e{LETTERS}‐-‧]")

#: How the file's byte-level splitter cuts such text.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")

#: No piece goes on over a space, except after another of these.
BEFORE_SPACE = (" ", "\n", "\t", "\r")


class ByteBpe:
    """A vocabulary file. ``special`` tells whether special strings in a text become their ids.

    The library's splitter is slow where most words are new, so text of common characters is cut
    here and the library's model encodes each different piece once. Any other text, and any that
    holds a special string that counts, goes to the library whole.
    """

    def __init__(self, file: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        self.model = self.library.model
        self.alphabet = dict(enumerate(byte_alphabet()))
        spec = json.loads(file)
        self.strings = [t["content"] for t in spec["added_tokens"] if special or not t["special"]]
        cut = spec["pre_tokenizer"] or {}
        self.plain = (
            spec["normalizer"] is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex") is True
            and cut.get("add_prefix_space") is False
        )
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        back = {c: b for b, c in self.alphabet.items()}
        names = self.library.get_vocab(with_added_tokens=True)
        out = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            out[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        return out

    def of_piece(self, piece: str) -> bytes:
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():  # of these only the space has another name
                word = piece.replace(" ", self.alphabet[0x20])
            else:
                word = piece.encode().decode("latin-1").translate(self.alphabet)
            ids = array.array("i", [token.id for token in self.model.tokenize(word)]).tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def of_pieces(self, text: str) -> bytes:
        """The ids of a common text, as bytes."""
        get = self.known.get
        return b"".join([get(p) or self.of_piece(p) for p in PIECE.findall(text)])

    def common(self, text: str) -> bool:
        return self.plain and not UNCOMMON.search(text) and not any(s in text for s in self.strings)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as 32-bit integers."""
        if not self.common(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(self.of_pieces(text), np.int32)

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, which holds no space, with a space before it, as bytes."""
        get, one, out = self.known.get, self.of_piece, []
        for word in words:
            piece = " " + word
            ids = get(piece)
            if ids is None:
                if word.isalpha():
                    ids = one(piece)
                elif word[:-1].isalpha():  # the last character is no letter
                    start, last = piece[:-1], word[-1]
                    ids = (get(start) or one(start)) + (get(last) or one(last))
                else:
                    ids = self.of_pieces(piece)
            out.append(ids)
        return out

    def encode_all(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, pa.Array]:
        """The ids of many texts, each with ``end`` behind: where each text's ids end, and all ids.

        A text is a head, up to its first space, and words that each follow a space; each
        different word is encoded once. A null text counts as empty. Texts that cannot be cut at
        spaces are a head only.
        """
        heads, whole = [], []
        for text in texts.to_numpy(zero_copy_only=False).tolist():
            text = text or ""
            cut = self.common(text) and not any(c + " " in text for c in BEFORE_SPACE)
            head = text.partition(" ")[0] if cut else text
            heads.append(self.encode(head).tobytes() if head else b"")
            whole.append(not cut)
        if any(whole) or texts.null_count:
            texts = pc.if_else(pc.or_(pa.array(whole, pa.bool_()), pc.is_null(texts)), pa.scalar("", texts.type), texts)
        split = pc.split_pattern(texts, " ")
        words = split.values.dictionary_encode()
        ids = self.of_words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        # where a text begins stands its head, and behind it the end
        bounds = split.offsets.to_numpy()
        which = words.indices.to_numpy().copy()
        which[bounds[:-1]] = len(ids) + np.arange(len(heads))
        which = np.insert(which, bounds[1:], len(ids) + len(heads))
        ids += [*heads, b"" if end is None else np.int32(end).tobytes()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        known = pa.LargeListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(sizes))), pa.array(np.frombuffer(b"".join(ids), np.int32))
        )
        ends = np.cumsum(sizes[which])[bounds[1:] + np.arange(len(heads))]
        return ends, known.take(pa.array(which)).flatten()


@functools.lru_cache(maxsize=2)
def loaded(file: str, special: bool) -> ByteBpe:
    """The vocabulary of a file's content; a worker keeps it, and the pieces it knows, from task to
    task."""
    return ByteBpe(file, special)
