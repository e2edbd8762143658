"""Tokenizing whole texts with a public tokenizer, each distinct white-space delimited part once per worker."""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Parts in each of a worker's two generations: when the young one is full it becomes the old one, whose parts in use come back.
CACHE_PARTS = 250_000
#: White space besides the space and the line feed, and NUL, which marks cuts.
_RARE = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Between a letter or number and ASCII punctuation there is always an end of a token.
_MARK = re.compile(r"(?<=[^\W_])(?=[!-/:-@\[-`{-~])")
#: A Latin-1 text of nothing else, without those runs, has single full stops and commas after letters or numbers for all its punctuation.
_PLAIN = bytes(c for c in range(256) if chr(c).isalnum()) + b" \n.,"
_RUNS = (b"..", b",,", b".,", b",.", b" .", b" ,", b"\n.", b"\n,")
_ODD = ("  ", " \n", "\n ", "\n\n")
_UNSURE: list[re.Pattern] = []
_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


def unsure() -> re.Pattern:
    """Letters and numbers that end with a mark once they are composed and lower-cased, as the capital I with a dot does: behind those no token needs to end."""
    if not _UNSURE:
        ends = (c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not unicodedata.normalize("NFC", c).lower()[-1].isalnum())
        _UNSURE.append(re.compile(f"[{''.join(ends)}]"))
    return _UNSURE[0]


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def _byte_letters() -> dict[int, str]:
    """Of Latin-1 letters and the space, the printable letters that byte-level BPE has for their UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256) if chr(c).isalpha() or c == 32}


_LETTERS = _byte_letters()


class _Parts(dict):
    """Part -> packed ids; what is missing is encoded. A part of Latin letters is one word to the tokenizer, so its model is asked at once."""

    def __init__(self, tok: Tokenizer, code: str, lower: bool):
        super().__init__()
        self.tok, self.code, self.lower, self.old = tok, code, lower, {}
        tests = [w + chr(c) + "b" for c in _LETTERS if c != 32 for w in ("", "xa")]
        self.direct = all(not self._word(w) or self._model(w) == self._whole(w) for w in tests)

    def _word(self, part: str) -> bool:
        return (part[1:] if part[:1] == " " and not self.lower else part).isalpha() and _latin(part) and not (self.lower and part != part.lower())

    def _model(self, part: str) -> bytes:
        return array(self.code, [t.id for t in self.tok.model.tokenize(part.translate(_LETTERS))]).tobytes()

    def _whole(self, part: str) -> bytes:
        return array(self.code, self.tok.encode(part, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.pop(part, None)
        if ids is None:
            ids = self._model(part) if self.direct and self._word(part) else self._whole(part)
        if len(self) >= CACHE_PARTS:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Encoder:
    """Ids as packed bytes of .dtype, equal to Tokenizer.encode(text, add_special_tokens=False).

    mode "space": a token may begin with the one space before it, so texts are cut before single spaces and around single
    line feeds. mode "drop": white space separates tokens and is dropped, so texts are cut at it. Both also cut between
    letters or numbers and punctuation. No token crosses a cut; where white space is unusual, or letters are of which the
    normaliser makes marks, cuts are fewer or none.
    """

    def __init__(self, path: str, mode: str):
        self.tok, self.mode = Tokenizer.from_file(path), mode
        small = self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.dtype = np.dtype("=u2" if small else "=u4")
        self.lower = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("Éa") == "éa"
        self.normal = self.tok.normalizer is not None
        self.get = _Parts(self.tok, "H" if small else "I", self.lower).__getitem__
        # a text that holds a special token's string is left whole, as the string has punctuation
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def parts(self, text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
            plain = not raw.translate(None, _PLAIN) and raw[:1] not in (b".", b",") and not any(x in raw for x in _RUNS)
        except UnicodeEncodeError:
            raw, plain = None, False
        if not plain and (_RARE.search(text) or any(x in text for x in self.special)):
            return [text]
        if raw is None and self.normal and unsure().search(text):
            return [text]
        if self.mode == "drop":
            if self.lower and raw is not None:
                text = text.lower()  # as the normaliser will; other letters are left to it
            text = text.replace(".", " .").replace(",", " ,") if plain else _MARK.sub(" ", text)
            return text.replace("\n", " ").split(" ")
        if any(x in text for x in _ODD) or text[:1] in " \n" or text[-1:] in " \n":
            return _CUT.split(text)
        text = text.replace(".", "\0.").replace(",", "\0,") if plain else _MARK.sub("\0", text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.get, self.parts(text))) if text else b""


def encoder(path: str, mode: str) -> Encoder:
    if (path, mode) not in _ENCODERS:
        _ENCODERS[path, mode] = Encoder(path, mode)
    return _ENCODERS[path, mode]
