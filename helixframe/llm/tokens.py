"""Token ids and token counts with public vocabulary files.

``BpeIds`` gives the ids of a byte-level BPE file as the ``tokenizers`` library does.
Texts whose code points all lie below ``PROVEN`` go through ``tiktoken`` built from the
same file, which is four times as fast and was compared with ``tokenizers`` on every
one of those code points (tests/llm/test_packing.py); all other texts go through
``tokenizers`` itself, and so do texts with a run of white space of ``LONG_RUN``
characters, over which the pattern of ``tiktoken`` would run out of its stack.

``word_counts`` counts tokens of a vocabulary that drops white space: no token spans
white space there, so counts add up over words and each distinct word is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache

import numpy as np

#: Code points below this split alike in both libraries.
PROVEN = 0x3100
_BEYOND = re.compile(f"[{chr(PROVEN)}-\U0010ffff]")
#: White space in a row from which a text goes through ``tokenizers``.
LONG_RUN = 100_000
_SPACE = re.compile(r"\s+")

#: Fixed value: the pattern by which byte-level BPE of this family splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeIds:
    """Ids of texts under a byte-level BPE ``.json`` file, without added special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if _BEYOND.search(text) or len(text) >= LONG_RUN and any(len(run[0]) >= LONG_RUN for run in _SPACE.finditer(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


def tokenizer_version(path: str) -> str:
    """SHA-256 of the vocabulary file: the version under which counts are kept."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounts:
    """Token counts of whole texts from kept counts of their words; bounded in memory.

    A word of ASCII letters is one piece for the library's model, and a run of sentence
    marks behind it another; all other words go through the whole library.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole, self.most, self.kept = Tokenizer.from_file(path), most, {}
        self.model = self.whole.model

    def _encode(self, new: list[bytes]) -> None:
        odd = []
        for w in new:
            stem = w.rstrip(b".,;:!?")
            if stem and stem.isalpha():
                marks = len(self.model.tokenize(w[len(stem) :].decode())) if len(stem) < len(w) else 0
                self.kept[w] = len(self.model.tokenize(stem.lower().decode())) + marks
            else:
                odd.append(w)
        if odd:
            found = self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)
            self.kept.update(zip(odd, (len(e.ids) for e in found), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if len(self.kept) > self.most:
                self.kept.clear()
            words = text.encode("utf-8", "replace").split()
            got = list(map(self.kept.get, words))
            if None in got:
                self._encode(list({w for w, c in zip(words, got, strict=True) if c is None}))
                got = map(self.kept.__getitem__, words)
            out.append(sum(got))
        return out


@cache
def word_counts(path: str) -> WordCounts:
    """One counter a process, so that its words outlast a task."""
    return WordCounts(path)


@cache
def bpe_ids(path: str) -> BpeIds:
    return BpeIds(path)
