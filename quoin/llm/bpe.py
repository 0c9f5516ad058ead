"""Byte-level BPE ids of a ``tokenizers`` vocabulary file.

The library itself encodes about 1 MB of text a CPU second here, which is over the limit of 400 CPU
seconds a GB of compressed input. The same merges run about five times as fast in ``tiktoken``, so the
vocabulary and pattern are read from the library's file and the library stays in use for texts that
hold one of its added tokens or a white-space run too long for the other. Tests hold both against each other, over odd Unicode too.
"""

from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers

from .common import trim

BYTE_BPE = "byte_bpe_50k.json"
_HELD: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b) if b in keep else chr(next(rest)): b for b in range(256)}


class Encoder:
    """Encodes whole texts to unsigned 32-bit ids, without special tokens of its own."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._tokenizer = path, None
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.added = [t["content"] for t in read["added_tokens"]]
        ranks = {bytes(letters[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("quoin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        del read, ranks
        trim()

    @property
    def tokenizer(self):
        """The library, loaded when it is first asked for."""
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(t in text for t in self.added):
            return self._library(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its regex engine gives up on white-space runs from some 100 000 characters on
            return self._library(text)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process; workers keep it between tasks."""
    path = path or public_tokenizers.path(BYTE_BPE)
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
