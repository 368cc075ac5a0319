"""Ids of the public word-level BPE vocabulary, at several times the speed of encoding whole texts.

The vocabulary file is read as it is. Its merges are applied by a rank-driven
byte-pair encoder with a blank standing for "end of word"; since the file's
ids rise in merge order, ids and ranks are the same numbers. Texts with
characters outside a plain Latin repertoire go through the file's own
tokenizer, whose normaliser and pre-tokeniser treat them by tables of their
own. Tests hold both ways against the tokenizer on whole texts.

The contents of special tokens in a text get their ids, as with the tokenizer's
own settings; or, with literal=True, are encoded like other text.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Characters that the fast way covers: printable ASCII, its white space, Latin letters and common signs without U+0130 (its lower case has two characters), and typographic dashes and quotes.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~¡-¬®-įı-ſ‐-―‘-„…]*")
#: In lower-cased plain text: the contractions of the vocabulary's pre-tokeniser, single digits, runs of neither letters nor digits.
_BREAKS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼-¾]|[^\\sa-z0-9ª²³µ¹º¼-¾À-ÖØ-öø-ſ]+")
#: Code points of a long text that are encoded together; a word isn't cut.
SLICE = 1 << 20
_BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str, literal: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = literal
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.apart = re.compile("|".join(map(re.escape, special))) if special and not literal else None
        byte_of = _byte_letters()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = len(token) > 4 and token.endswith("</w>")
                core = token[:-4] if ends else token
                ranks[bytes(byte_of[c] for c in core) + b" " * ends] = i
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if _PLAIN.fullmatch(text) and not (self.apart and self.apart.search(text)):
            spaced = _BREAKS.sub(r" \g<0> ", text.lower().translate(_BLANKS) if not text.isascii() else _ascii_blanks(text.lower()))
            return self.fast.encode_ordinary(spaced + " ")
        return self.whole.encode(text, add_special_tokens=False).ids

    def ids(self, text: str, end_id: int) -> np.ndarray:
        """The text's ids and then end_id. Long texts are encoded in slices that end before a space or newline, which is never part of a token."""
        parts, at = [], 0
        while len(text) - at > SLICE:
            stop = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE))
            if stop <= at:
                stop = min((i for i in (text.find(" ", at + 1), text.find("\n", at + 1)) if i > 0), default=len(text))
            parts.append(np.array(self.encode(text[at:stop]), dtype="<u4"))
            at = stop
        return np.concatenate([*parts, np.array([*self.encode(text[at:]), end_id], dtype="<u4")])


def _ascii_blanks(text: str) -> str:
    for c in "\n\t\r\x0b\x0c":
        text = text.replace(c, " ")
    return text


@functools.lru_cache(maxsize=2)
def loaded(path: str, literal: bool = False) -> WordBpe:
    """One encoder a process, path and way with special tokens."""
    return WordBpe(path, literal)
