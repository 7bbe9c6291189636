"""Token ids of whole texts under a given byte-level vocabulary.

The vocabulary cuts a text before every space that follows a character other than white space, whatever
stands around it, and before and after a line's end between characters other than white space, so a text can be
encoded piece by piece, and a piece met before needs no second encoding. Texts whose white space is single spaces
and line ends are cut as arrays, many at a time; their pieces are looked up together in a table of fixed size with
one place for each hash, and only those that aren't there are encoded, each distinct one once.
A piece of Latin letters, digits and ASCII signs falls into words by the vocabulary's own rule; each word
goes to the model of the tokenizers library. Any other piece goes through the library's whole encoder, and
so does a text that holds a token added to the vocabulary (an end-of-text mark, say), which is then that token.
"""

from __future__ import annotations

import re
import string
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np

#: Pieces (and words) that a worker remembers, and the length above which one isn't worth remembering.
REMEMBERED, SHORT = 150_000, 48
#: Characters that are cut at a time, and bytes of the pieces that are told apart as arrays.
GROUP, KEY = 500_000, 24
#: Places for such pieces in a worker (a power of two), and the most ids that one holds.
PLACES, WIDE = 1 << 19, 9
PIECE = np.dtype([("bytes", "<u8", 3), ("ids", "<u4", WIDE), ("size", "u1"), ("n", "u1")], align=True)

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACED = re.compile(r"\s ")
#: White space other than spaces and line ends.
_RARE_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?= )")
_PLAIN = re.compile(rf"[!-~{_LETTER}](?:[!-~{_LETTER}]|\n(?=[!-~{_LETTER}]))*")
#: The word rule of the vocabulary, for the characters of a plain piece.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\n")

#: A single sign after a word is a word of its own, unless an apostrophe or further signs stand with it.
_STOPS = (",", ".", "!", "?", ";", ":")

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STOP_BYTES, _ALNUM_BYTES = (np.isin(np.arange(256), [ord(c) for c in signs]) for signs in ("".join(_STOPS), string.ascii_letters + string.digits))

_encoders: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)}


_LETTERS = "".join(byte_letters()[b] for b in range(256))


class Memory(dict):
    """Little-endian unsigned 32-bit ids by string, found on first use.

    When it is full it becomes the older generation, whose strings move to the new one as they are met again; what
    isn't met until that is full too is forgotten.
    """

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.find(piece)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are tokens wherever they stand, whatever stands around them.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.words = Memory(self._word)
        self.bytes, self.pieces = Memory(self._bytes), np.zeros(PLACES, PIECE)
        self.whole, self.spaced = Memory(self._piece), Memory(lambda piece: self._piece(piece, " "))

    def forget(self) -> None:
        """Drop the older generations, so that a worker that goes on with other work holds less."""
        for memory in (self.bytes, self.words, self.whole, self.spaced):
            memory.older = {}

    def _word(self, word: str) -> bytes:
        return self._coded(word.encode())

    def _coded(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(charmap_decode(word, "strict", _LETTERS)[0])]).tobytes()

    def _bytes(self, piece: bytes) -> bytes:
        text = piece.decode()
        lead, core = (" ", text[1:]) if text[0] == " " else ("", text)
        return self._coded(piece) if core.isalpha() else self._piece(core, lead)

    def _piece(self, piece: str, lead: str = "") -> bytes:
        if piece.isalpha():
            return self._word(lead + piece)
        if piece[-1:] in _STOPS and piece[:-1].isalpha():
            return self.spaced[piece[:-1]] + self.words[piece[-1]] if lead else self.whole[piece[:-1]] + self.words[piece[-1]]
        if _PLAIN.fullmatch(piece):
            return b"".join(map(self.words.__getitem__, _WORD.findall(lead + piece)))
        return array("I", self.tokenizer.encode(lead + piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None, end: int) -> bytes:
        """Ids of the text and then the end id, as bytes of unsigned 32-bit numbers."""
        last = int(end).to_bytes(4, "little")
        if not text:
            return last
        if any(token in text for token in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + last
        if _SPACED.search(text):
            return b"".join(map(self.whole.__getitem__, _CUT.split(text))) + last
        first, *rest = text.split(" ")
        return (self.whole[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest)) + last

    def encode_all(self, texts: Iterable[str | None], end: int) -> Iterator[bytes]:
        """encode() of each text, in their order."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= GROUP:
                yield from self._group(held, end)
                held, size = [], 0
        yield from self._group(held, end)

    def _plain(self, text: str) -> bool:
        """Whether spaces and line ends stand alone, and there is no other white space and no added token."""
        if not 0 < len(text) <= GROUP or _RARE_SPACE.search(text) or any(token in text for token in self.added):
            return False
        return not any(pair in text for pair in ("  ", " \n", "\n ", "\n\n")) and "\n" not in (text[0], text[-1])

    def _group(self, texts: list[str], end: int) -> Iterator[bytes]:
        plain = [self._plain(text) for text in texts]
        found = iter(self._cut(list(compress(texts, plain))))
        last = int(end).to_bytes(4, "little")
        for text, known in zip(texts, plain):
            yield next(found) + last if known else self.encode(text, end)

    def _cut(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        coded = [text.encode() for text in texts]
        data, ends = b"".join([*coded, bytes(KEY)]), np.cumsum([len(c) for c in coded])
        total = int(ends[-1])
        letters = np.frombuffer(data, np.uint8, total)
        line = letters == 10
        cut = np.append((letters == 32) | line, True)
        cut[1:] |= np.append(line[:-1], False) if total else False
        cut[0] = True
        cut[ends] = True
        stop = _STOP_BYTES[letters] & cut[1:]
        cut[1:total] |= stop[1:] & _ALNUM_BYTES[letters[:-1]]  # a sign that ends a word is a piece
        starts = np.flatnonzero(cut[:total])
        sizes = np.diff(starts, append=total)
        # pieces of up to KEY bytes are told apart by their bytes, as three numbers
        words = [np.ndarray((total,), "<u8", data, at, (1,))[starts] & _MASKS[np.clip(sizes - at, 0, 8)] for at in (0, 8, 16)]
        mixed = sizes.astype(np.uint64)
        for word in words:
            mixed = (mixed ^ word) * _MIX
            mixed ^= mixed >> np.uint64(29)
        places = mixed & np.uint64(len(self.pieces) - 1)
        held = self.pieces.take(places)
        known = held["size"] == sizes
        for number, word in enumerate(words):
            known &= held["bytes"][:, number] == word
        # the others are looked up each, once in a group
        other = np.flatnonzero(~known)
        found: dict[bytes, bytes] = {}
        ids = []
        for a, n in zip(starts[other].tolist(), sizes[other].tolist()):
            piece = data[a : a + n]
            known_ids = found.get(piece)
            if known_ids is None:
                known_ids = found[piece] = self._bytes(piece) if n <= KEY else self.bytes[piece]
            ids.append(known_ids)
        each = held["n"].astype(np.int64)
        each[other] = counts = np.array([len(x) // 4 for x in ids], np.int64)
        after = np.cumsum(each)
        every = np.empty(after[-1], "<u4")
        looked = np.repeat(~known, each)
        got = np.frombuffer(b"".join(ids), "<u4")
        every[looked] = got
        every[~looked] = held["ids"][np.arange(WIDE) < (held["n"] * known)[:, None]]
        # a piece takes the place of the one that was there
        fits = (sizes[other] <= KEY) & (counts <= WIDE)
        new, row = other[fits], np.zeros(int(fits.sum()), PIECE)
        row["size"], row["n"] = sizes[new], counts[fits]
        row["bytes"] = np.stack([word[new] for word in words], axis=1)
        row["ids"][np.arange(WIDE) < row["n"][:, None]] = got[np.repeat(fits, counts)]
        self.pieces[places[new]] = row
        bounds = np.concatenate([[0], after[np.searchsorted(starts, ends) - 1]]).tolist()
        return [every[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
