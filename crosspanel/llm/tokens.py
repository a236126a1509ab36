"""Public tokenizers on the executors: opened by path, one for each worker, with caches of bounded size."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: Chunks between white space whose ids a worker remembers (about 150 bytes each), and how many outlive a full cache.
CACHE, KEPT = 120_000, 60_000
#: Texts of these characters alone are cut at white space before they are encoded: there, cutting, lower-casing and
#: composing chunk by chunk give what the whole text gives. Special tokens' strings start with "<|".
_PLAIN = re.compile("[^\t-\r -~¡-įı-ɏ‐-‧]|<\\|")
#: The vocabulary's own cut, in the range above: contractions, letters, single digits, runs of other marks.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\w\\s]|_)+")
_END = "\x00"


@lru_cache(maxsize=4)
def word_tokenizer(path: str):
    """The tokenizer itself, and its merges as byte ranks in which a NUL stands for the end of a word."""
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    plain = {c: bytes([ord(c)]) for c in alphabet if ord(c) < 256}
    rest = iter(b for b in range(256) if bytes([b]) not in plain.values())
    plain |= {c: bytes([next(rest)]) for c in alphabet if c not in plain}
    ranks, last = {}, np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
    for token, i in model["vocab"].items():
        ends = token.endswith("</w>") and len(token) > 4
        if set(stem := token[:-4] if ends else token) <= plain.keys() and not token.startswith("<|"):
            ranks[b"".join(plain[c] for c in stem) + b"\0" * ends] = i
            last[i] = ends
    return Tokenizer.from_file(path), tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), last


class PackedEncoder:
    """Texts -> their ids as little-endian unsigned 32-bit numbers, exactly as the tokenizer gives them for whole texts."""

    def __init__(self, path: str):
        self.tokenizer, self.words, self.last = word_tokenizer(path)
        self.ids: dict[str, bytes] = {"": b""}

    def _learn(self, chunks: list[str]) -> None:
        cut = [_CUT.findall(c) for c in chunks]
        ids = np.array(self.words.encode_ordinary("".join([w + _END for words in cut for w in words])), dtype="<u4")
        word_ends = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
        at = (4 * word_ends[np.cumsum([0, *map(len, cut)])]).tolist()
        packed = ids.tobytes()
        self.ids.update(zip(chunks, map(packed.__getitem__, map(slice, at[:-1], at[1:])), strict=True))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > CACHE:
            self.ids = dict(islice(self.ids.items(), KEPT))
        chunks = [None if _PLAIN.search(t) else t.lower().split() for t in texts]
        if new := list(set().union(*(c for c in chunks if c)) - self.ids.keys()):
            self._learn(new)
        return [self.whole(t) if c is None else b"".join(map(self.ids.__getitem__, c)) for t, c in zip(texts, chunks, strict=True)]


@lru_cache(maxsize=4)
def byte_tokenizer(path: str):
    """A byte-level vocabulary of ranks; control strings in a text are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
