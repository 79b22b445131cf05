"""Pre-tokens of a byte-level word tokenizer, and the tokens of each.

A text's tokens are the tokens of its pre-tokens one after the other, so a pre-token's tokens can be looked up. Texts
in plain Latin letters are cut by one regular expression; any other text, and one with a special string in it, is
cut by the tokenizer's own normaliser and splitter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Characters on which the short way and the tokenizer agree: they are their own composed form, have a one-character
#: lower case, and are a letter, a digit, white space or a sign for both.
PLAIN = "".join(
    chr(i)
    for i in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x180))
    if i not in (0xAD, 0x130, 0x149, 0x17F) and unicodedata.normalize("NFC", chr(i)) == chr(i)
)
LETTERS = "".join(sorted({c.lower() for c in PLAIN if unicodedata.category(c)[0] == "L"}))
DIGITS = "".join(c for c in PLAIN if unicodedata.category(c)[0] == "N")
_letters, _digits = re.escape(LETTERS), re.escape(DIGITS)
NOT_PLAIN = re.compile(f"[^{re.escape(PLAIN)}]")
#: The character a byte-level vocabulary writes for each byte: itself where it shows, else the next free one from 256.
SHOWN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
BYTES = {b: b if b in SHOWN else 256 + sum(i not in SHOWN for i in range(b)) for b in range(256)}
CUT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_digits}]|[^\x09-\x0D\x20{_letters}{_digits}]+"
)


class Cutter:
    """Cuts texts into pre-tokens with the settings of a tokenizer file, and tokenizes single pre-tokens.

    Special strings are pre-tokens of their own, marked by a leading NUL, which no pre-token cut the short way begins with.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.special = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self.whole = Tokenizer.from_file(path)
        split = settings["pre_tokenizer"]["pretokenizers"][0]
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        # pre-tokens come normalised, and are no place to look for special strings
        settings |= {"added_tokens": [], "normalizer": None}
        self.bare = Tokenizer.from_str(json.dumps(settings))
        suffix = settings["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.bare.get_vocab_size(), bool)
        self.ends[[i for token, i in self.bare.get_vocab().items() if token.endswith(suffix)]] = True
        self.model = self.bare.model
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def cut(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text) and not (("<|" in text) and self.marks.search(text)):
            return CUT.findall(text.lower())
        out = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                clean = self.whole.normalizer.normalize_str(part)
                out += [clean[a:b] for _, (a, b) in self.split.pre_tokenize_str(clean)]
        return out

    def ids(self, piece: str) -> list[int]:
        """Token ids of one pre-token, straight from the tokenizer's model."""
        if piece[:1] == "\0" and piece[1:] in self.special:
            return [self.special[piece[1:]]]
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(BYTES)
        return [token.id for token in self.model.tokenize(piece)]

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pre-tokens one after the other, and how many each has.

        They are tokenized as one text of many words: no pre-token holds white space, and the last token of each, and
        no other, carries the mark of a word's end.
        """
        marked = {i: self.special[p[1:]] for i, p in enumerate(pieces) if p[:1] == "\0" and p[1:] in self.special}
        plain = [p for i, p in enumerate(pieces) if i not in marked] if marked else pieces
        ids = np.array(
            [t for a in range(0, len(plain), 1000) for t in self.bare.encode(" ".join(plain[a : a + 1000])).ids], np.uint32
        )
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(lengths) != len(plain):
            raise ValueError("the tokenizer does not mark the ends of words")
        if marked:
            where = np.array(sorted(marked)) - np.arange(len(marked))
            at = np.concatenate([[0], np.cumsum(lengths)])[where]
            ids = np.insert(ids, at, [marked[i] for i in sorted(marked)])
            lengths = np.insert(lengths, where, 1)
        return ids, lengths


@lru_cache(1)
def cutter(path: str) -> Cutter:
    return Cutter(path)
