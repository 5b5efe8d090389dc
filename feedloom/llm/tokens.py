"""Token ids of whole texts, as the tokenizers library gives them, at the speed of a word cache.

Both kinds of public vocabulary never merge across certain spaces: text is cut
there and a document's ids are its words' ids in a row. A word that isn't
cached is cut into the runs the vocabulary's own pattern would cut, and the
library's model encodes each run that isn't cached either. Words with
characters beyond those the cuts are certain for go through the library's
whole chain, and so do texts that hold an added token (the library finds those
before it cuts) and texts of other vocabularies.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Any

import numpy as np

#: Words, and runs, kept by a worker; at the limit a cache starts anew.
CACHE_WORDS = 250_000
#: Characters for which the cuts below are those of the vocabularies' patterns.
SURE = re.compile(r"[ \n\t\r!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
LETTERS, SYMBOLS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+", r"[!-/:-@\[-`{-~]+"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
RUNS = {"bytes": re.compile(rf"{SHORT}| ?{LETTERS}| ?[0-9]+| ?{SYMBOLS}|\s+(?!\S)|\s+"), "words": re.compile(rf"{SHORT}|{LETTERS}|[0-9]|{SYMBOLS}")}


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


LETTER_OF = byte_letters()


def unsure(text: str) -> bool:
    """Whether a space stands between white space, where a byte-level vocabulary's words aren't simply cut."""
    if not text.isascii():
        return bool(re.search(r"  |\s \s", text))
    return "  " in text or any(c in text for c in ("\n ", "\t ", "\r ", "\v ", "\f "))


PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Known(dict[str, bytes]):
    """A word's or run's ids, found by `find` the first time."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.find = find

    def __missing__(self, key: str) -> bytes:
        ids = self[key] = self.find(key)
        return ids


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind, self.added = self._kind(spec), [t["content"] for t in spec.get("added_tokens") or ()]
        self.cache_words, self.tokenize = cache_words, self.tokenizer.model.tokenize
        self.words, self.runs = Known(self._word), Known(self._run)
        self.cut = RUNS[self.kind].findall if self.kind in RUNS else None

    @staticmethod
    def _kind(spec: dict[str, Any]) -> str:
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") and any(t["normalized"] for t in spec.get("added_tokens") or ()):
            return "whole"  # such a token may stand in a text only after it is normalized
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "bytes"
        if pre.get("type") == "Sequence" and spec["model"].get("end_of_word_suffix") == "</w>" and (spec.get("normalizer") or {}).get("type") == "Sequence":
            return "words"
        return "whole"

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _run(self, run: str) -> bytes:
        if not run.isprintable():
            return self._whole([run])[0]
        letters = run.replace(" ", LETTER_OF[0x20]) if run.isascii() else run.encode().decode("latin-1").translate(LETTER_OF)
        ids = [t.id for t in self.tokenize(letters)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not SURE.fullmatch(word):
            return self._whole([word])[0]
        parts = self.cut(word if self.kind == "bytes" else word.lower())
        return self.runs[parts[0]] if len(parts) == 1 else b"".join([self.runs[run] for run in parts])

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.kind == "whole":
            return self._whole(texts)
        out: list[bytes] = []
        for i, text in enumerate(texts):
            if not i % 64:
                for known in (self.words, self.runs):
                    if len(known) > self.cache_words:
                        known.clear()
                        known[""] = b""
            ids = self.words.__getitem__
            if any(t in text for t in self.added):
                out += self._whole([text])
            elif self.kind == "words":
                out.append(b"".join(map(ids, text.replace("\n", " ").split(" "))))
            elif unsure(text):
                out += self._whole([text])
            else:
                head, *words = text.split(" ")
                out.append(ids(head) + b"".join(map(ids, map(" ".__add__, words))))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker: its word cache serves all tasks of the worker."""
    return WordEncoder(path)
