"""Tokenizing whole texts with byte-level vocabularies, and tables of distinct words."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words of a table: about 250 bytes each.
LIMIT = 500_000


class WordTable:
    """What ``encode`` makes of each distinct word, made once for as long as the table holds it.

    A table belongs to one Python worker and outlives its tasks. It holds about ``limit`` words: a full
    one is emptied before the next texts, so memory is bounded and no word is ever left out.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = LIMIT):
        self.encode, self.limit, self.entries = encode, limit, {}

    def rows(self, lists: list[list[str]]) -> list[list]:
        """The entries of these lists of words, in place."""
        if len(self.entries) > self.limit:
            self.entries.clear()
        get = self.entries.get
        found = [list(map(get, words)) for words in lists]
        holes = [i for i, got in enumerate(found) if None in got]
        if holes:
            missing = list({w for i in holes for w, x in zip(lists[i], found[i], strict=True) if x is None})
            self.entries.update(zip(missing, self.encode(missing), strict=True))
            for i in holes:
                found[i] = list(map(get, lists[i]))
        return found


#: The patterns by which the two byte-level vocabularies cut texts.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSPACED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters beyond these may be classed differently by two libraries' versions of Unicode.
_UNSURE = re.compile("[^\n\x20-\x7e\xa1-\xac\xae-ɏΆ-ώЀ-џ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
#: Of those, what is its own composed form, and lowers to such characters one by one.
_UNSURE_LOWER = re.compile("[^\n\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ǃ‐-‧€]")
#: The pieces of UNSPACED in texts of those characters.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ňŊ-ǃ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
#: Ends a word; a control character, which no text that _UNSURE_LOWER passes holds.
_END = "\x01"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """Ids as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    Texts of well-known characters run through a byte-pair engine over the same merges, which is several
    times faster; any other text, and any that may hold an added token such as <|endoftext|>, goes through
    the library itself as it is loaded. Vocabularies whose words end in '</w>'
    get a control character for it: it joins the byte before it ahead of all merges.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        alphabet, suffix = byte_alphabet(), kept["model"]["end_of_word_suffix"]
        special = {x["content"] for x in kept["added_tokens"]}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)", re.I)
        self.ends = bool(suffix)
        ranks: dict[bytes, int] = {}
        ids = []
        for token, i in sorted(((t, i) for t, i in kept["model"]["vocab"].items() if t not in special), key=lambda x: (not (suffix and x[0].endswith(suffix) and len(x[0]) == len(suffix) + 1), x[1])):
            last = bool(suffix) and token.endswith(suffix)
            ranks[bytes(alphabet[c] for c in (token[: -len(suffix)] if last else token)) + (_END.encode() if last else b"")] = len(ids)
            ids.append(i)
        self.ids = np.array(ids, "<u4")
        self.engine = tiktoken.Encoding("engine", pat_str=rf"[^\s{_END}]+{_END}" if self.ends else SPACED, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added.search(text):
            pass
        elif self.ends:
            if not _UNSURE_LOWER.search(text):
                text = _END.join(_PIECE.findall(text.lower()))
                return self.ids[self.engine.encode_to_numpy(text + _END, disallowed_special=())].tobytes() if text else b""
        elif not _UNSURE.search(text):
            return self.ids[self.engine.encode_to_numpy(text, disallowed_special=())].tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_VOCABULARIES: dict[str, ByteVocabulary] = {}


def encode_all(found: list[str], path: str) -> list[bytes]:
    """The ids of each text by the vocabulary at path, which each Python worker loads once."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = ByteVocabulary(path)
    return list(map(_VOCABULARIES[path].encode, found))
