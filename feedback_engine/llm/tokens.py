"""Token ids of whole texts by a public tokenizer file, as little-endian unsigned 32-bit bytes.

A tokenizer that never looks across blanks (every piece of it matches within a
word, its normalisers are local) is applied word by word through a bounded cache
in each Python worker, and plain words go to its BPE model directly, which gives
the same ids several times faster than the whole text at once; any other tokenizer gets the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Split patterns known not to match across white space.
WORD_PATTERNS = {"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
#: Words held in each of the two generations of a worker's cache.
CACHE_WORDS = 700_000
_made: dict[str, Callable[[str], bytes]] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_local(spec: dict) -> bool:
    """Whether encoding a text is encoding its blank-separated words."""
    parts = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    normal = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in parts(spec["normalizer"], "normalizers"))
    pre = parts(spec["pre_tokenizer"], "pretokenizers")
    split = bool(pre) and pre[0]["type"] == "Split" and pre[0]["pattern"].get("Regex") in WORD_PATTERNS and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] or "\n" in a["content"] for a in spec["added_tokens"])
    return normal and split and plain and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:]) and spec["post_processor"] is None


#: Words of these characters alone need no normaliser but lower case, and split as WORD_PARTS says.
SIMPLE = re.compile(r"[!-~\u00c0-\u00ff]{1,64}")
WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, int]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Words(dict):
    """Bytes of ids by word; two generations, so frequent words outlive a full cache."""

    def __init__(self, tokenizer, special: list[str], most: int) -> None:
        super().__init__({"": b""})
        self.tokenizer, self.bpe, self.most, self.old = tokenizer, tokenizer.model.tokenize, most, {}
        self.special, self.letters = special, byte_letters()
        self.miss, self.simple = self.encode, False
        self.four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size() + 1)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, word: str) -> bytes:
        if not SIMPLE.fullmatch(word) or "<" in word and any(x in word for x in self.special):
            return self.whole(word)
        parts = WORD_PARTS.findall(word.lower())
        if parts == [word]:
            return self.plain(word)
        return b"".join([self[x] for x in parts])

    def plain(self, word: str) -> bytes:
        """Ids of lower-case letters."""
        four = self.four
        return b"".join([four[t.id] for t in self.bpe(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))])

    def latin(self, word: str) -> bytes:
        """encode() of a word of a lower-case Latin-1 text without special tokens."""
        core = word.rstrip(PUNCTUATION)
        if core.isalpha():  # letters are one part, and what follows them another
            return self.plain(core) if core == word else self[core] + self[word[len(core) :]]
        return self.encode(word)

    def text(self, text: str) -> bytes:
        """Ids of a text, word by word."""
        if "<|" not in text:
            try:  # Lower case of these letters is the same in and out of context, and hits the cache more often.
                text.encode("latin-1")
                text = text.lower()
                self.miss, self.simple = self.latin, True
            except UnicodeEncodeError:
                self.miss, self.simple = self.encode, False
        else:
            self.miss, self.simple = self.encode, False
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            if self.simple and word.isascii() and word.isalpha():
                four = self.four
                out = b"".join([four[t.id] for t in self.bpe(word)])
            else:
                out = self.miss(word)
            if len(word) > 64:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        self[word] = out
        return out


def encoder(path: str | None = None) -> Callable[[str], bytes]:
    """text -> bytes of its ids, without special tokens; made once in each process."""
    path = path or vocabulary()
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        words = Words(Tokenizer.from_file(path), [a["content"] for a in spec["added_tokens"]], CACHE_WORDS)
        _made[path] = words.text if word_local(spec) else words.whole
    return _made[path]


def document_bytes(text: str | None, encode: Callable[[str], bytes], end_id: int = END_ID) -> bytes:
    """Ids of a document with its end id; a null text is empty."""
    return encode(text or "") + int(end_id).to_bytes(4, "little")
