"""Token ids of texts by a public byte-level BPE file.

Texts are encoded with the rank file of the same vocabulary where there is one
beside the tokenizer file (it is faster and gives the same ids); texts that hold
the string of a special token always go through the tokenizer file itself.

A text can be cut into pieces that the tokenizer never joins, in any script: the
tokenizer's pre-token pattern always starts a new pre-token where a run of letters or
of digits ends, where one follows a sign, and at a white space character before a
visible one. ``cuts`` finds such places by the classes of two neighbouring
characters (and one more after white space), so an edit only touches the pieces around
it. Only where the class of a character is the same in all versions of Unicode, it
takes part; after an apostrophe, which may begin a short form, no cut is made.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata

import numpy as np

#: Classes of characters: of no certain class, letter, digit, the space, other white space, sign, apostrophe.
_NONE, _LETTER, _DIGIT, _SPACE, _WHITE, _SIGN, _APOSTROPHE = range(7)
#: By the classes of two characters: whether a pre-token starts at the second, and, where these are
#: white space and what follows it, at the first. Of a run of white space the last character goes
#: with what follows; a piece that ends in the others has the same tokens alone.
_AT_SECOND, _AT_FIRST = np.zeros((7, 7), bool), np.zeros((7, 7), bool)
_AT_SECOND[_LETTER, [_DIGIT, _SPACE, _WHITE, _SIGN, _APOSTROPHE]] = True
_AT_SECOND[_DIGIT, [_LETTER, _SPACE, _WHITE, _SIGN, _APOSTROPHE]] = True
_AT_SECOND[_SIGN, [_LETTER, _DIGIT]] = True
for _c in (_LETTER, _DIGIT, _SIGN, _APOSTROPHE):
    _AT_FIRST[[_SPACE, _WHITE], _c] = True
#: White space other than the space (the property White_Space), and the end of the planes looked at.
_WHITES = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PLANES = 0x30000
_UNSURE = [*range(0x1C, 0x20), 0x180E]  # white space in some places only


@functools.cache
def _classes() -> np.ndarray:
    """The class of every character, by the categories in the oldest and in this version of Unicode."""
    def kind(category: str) -> int:
        return {"L": _LETTER, "N": _DIGIT, "Z": _NONE}.get(category[0], _NONE if category in ("Cn", "Co", "Cs") else _SIGN)

    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    out = np.zeros(0x110000, np.uint8)
    for c in map(chr, range(_PLANES)):
        k = kind(new(c))
        out[ord(c)] = k if k == kind(old(c)) else _NONE
    out[_WHITES], out[_UNSURE], out[0x20], out[0x27] = _WHITE, _NONE, _SPACE, _APOSTROPHE
    return out


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path or default_path())
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        ranks = (path or default_path()).removesuffix(".json") + ".tiktoken"
        self._ranks, self._sizes = _rank_encoding(ranks) if os.path.exists(ranks) else (None, None)

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self._special)

    def ordinary(self, text: str) -> np.ndarray:
        """Ids of a text in which the strings of special tokens are ordinary text."""
        if self._ranks is not None:
            return self._ranks.encode_to_numpy(text, disallowed_special=())
        self._tok.encode_special_tokens = True
        try:
            return np.array(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        finally:
            self._tok.encode_special_tokens = False

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; equal to ``whole``."""
        if not text:
            return b""
        return self.whole(text) if self.has_special(text) else self.ordinary(text).astype("<u4").tobytes()

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each piece of a text (one empty piece if it is empty)."""
        if not text:
            return np.zeros(1, np.int32), np.zeros(1, np.int32)
        starts, at = cuts(text)
        chars = np.diff(np.r_[starts, len(text)]).astype(np.int32)
        if self._ranks is None:
            ends = np.cumsum(chars).tolist()
            return chars, np.array([len(self.ordinary(text[e - n:e])) for e, n in zip(ends, chars.tolist())], np.int32)
        ids = self.ordinary(text)
        before = np.searchsorted(np.cumsum(self._sizes[ids]), at, side="right")  # tokens that end by then
        return chars, np.diff(np.r_[before, len(ids)]).astype(np.int32)


def cuts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a text start, in characters and in bytes of UTF-8."""
    if text.isascii():
        code = np.frombuffer(text.encode(), np.uint8)
    else:
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = _classes()[code]
    pair = kind[:-1] * np.uint8(7) + kind[1:]
    cut = _AT_SECOND.ravel()[pair]
    cut[:-1] |= _AT_FIRST.ravel()[pair[1:]]
    starts = np.r_[0, np.flatnonzero(cut) + 1]
    if code.dtype == np.uint8:
        return starts, starts
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return starts, (np.cumsum(width) - width)[starts]


def _rank_encoding(path: str):
    """The encoding of a rank file, and the bytes of each token."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


_ENCODERS: dict[str | None, PieceEncoder] = {}


def encoder(path: str | None = None) -> PieceEncoder:
    """One encoder per worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
