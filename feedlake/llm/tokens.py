"""Token ids of whole texts by a public tokenizer, each distinct piece of a batch looked up once.

Texts are cut where the tokenizer can join nothing that stands on both sides, Arrow numbers the
distinct pieces of a batch, and only pieces that are new to the process reach the tokenizer.
Texts for which that cut is not proven (white space in runs or of rare kinds, the string of an
added token) go to the tokenizer whole. The ids equal those of ``encode(text,
add_special_tokens=False)``, so the string of a special token is that token.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

BATCH_BYTES = 1 << 23  # of text that is cut and numbered at a time
CACHE_PIECES = 500_000  # of one Python worker; at this many the cache starts again
CACHE_CHARS = 48  # longer pieces are not kept

# White space other than single blanks and line feeds between words; NUL marks the cuts.
_ODD = (
    r"^\s|\s$|\s\s|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_MARK = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([.,!?;:|&*%$#])"
# Pieces of these characters are cut and mapped to bytes here; they have no normal form but
# their own and their lower case is one character.
_PLAIN = regex.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
_WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_BYTE_PARTS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+"
)
# Pieces that are one part.
_ONE_WORD_PART = r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]"
_ONE_BYTE_PART = r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others get code points from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of texts by one tokenizer file, with caches that are bounded by CACHE_PIECES."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.lower = self.tokenizer.normalizer is not None
        self.parts = _WORD_PARTS if self.lower else _BYTE_PARTS
        self.one_part = f"^(?:{_ONE_WORD_PART if self.lower else _ONE_BYTE_PART})\\z"
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = _Pieces(self)

    def whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self.letters)
        return pack([token.id for token in self.model.tokenize(letters)])

    def learn(self, pieces: list[str]) -> None:
        """Look up the new ones of these pieces that are one part, with one pass for all their letters."""
        new = [piece for piece in pieces if piece not in self.pieces]
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces.clear()
            new = pieces[:CACHE_PIECES]
        new = pa.array(new, pa.string())
        new = new.filter(pc.and_(pc.match_substring_regex(new, self.one_part), pc.less_equal(pc.utf8_length(new), CACHE_CHARS)))
        if not len(new):
            return
        new = new.to_numpy(zero_copy_only=False).tolist()
        joined = "\0".join(new)
        joined = (joined.lower() if self.lower else joined).encode().decode("latin-1").translate(self.letters)
        tokenize = self.model.tokenize
        for piece, letters in zip(new, joined.split(self.letters[0])):
            self.pieces[piece] = pack([token.id for token in tokenize(letters)])

    def has_added(self, texts: pa.Array) -> np.ndarray:
        """Which texts have the string of an added token; in any case of letters, where the tokenizer normalizes it."""
        found = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            any_case = token.normalized and self.lower
            found |= pc.match_substring(texts, token.content, ignore_case=any_case).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets between them."""
        texts = texts.fill_null("")
        if self.lower:
            # This kind drops white space, so blanks and line feeds are cuts anywhere.
            odd = self.has_added(texts) | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
            for mark in (" ", "\n"):
                plain = pc.replace_substring(plain, mark, "\0")
        else:
            # A piece begins with the blank or line feed before it.
            odd = self.has_added(texts) | pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
            for mark in (" ", "\n"):
                plain = pc.replace_substring(plain, mark, "\0" + mark)
        # A mark after a letter or digit begins a new word for both kinds.
        plain = pc.replace_substring_regex(plain, _MARK, "\\1\0\\2")
        pieces = pc.split_pattern(plain, "\0")
        numbered = pieces.flatten().dictionary_encode()
        which = numbered.indices.to_numpy(zero_copy_only=False)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        found = list(map(self.pieces.__getitem__, distinct))
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(size) - size
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        shift = np.repeat(begin[which] - upto[:-1], n)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.arange(upto[-1]) + shift]
        ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        offsets = upto[ends]
        if odd.any():
            parts = np.split(ids, offsets[1:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.frombuffer(self.whole(texts[int(i)].as_py()), dtype="<u4")
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def cut(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self.whole(piece)
        return b"".join(map(self.word, self.parts.findall(piece.lower() if self.lower else piece)))


class _Pieces(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = self.encoder.cut(piece) if piece else b""
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = found
        return found


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, Encoder] = {}


def release() -> None:
    """Drop the encoders of this process: later steps of its worker need the memory."""
    _ENCODERS.clear()


def encoder(path: str) -> Encoder:
    """The encoder of this process; it outlives a task, as the worker does."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
