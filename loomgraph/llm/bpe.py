"""Byte-pair vocabularies of public tokenizers: files, rank maps, and encoding one text in Python.

The vocabulary file (``<base64 of the token's bytes> <rank>`` a line) is read on the
driver from a path that is a parameter; its bytes (under 1 MB) travel with the tasks.
"""

from __future__ import annotations

import base64
import functools
import heapq
import importlib.util
import os
import re

#: Fixed value: how byte_bpe_50k cuts a text into words, and the characters it takes for white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same for Java's regular expressions, where \s would know ASCII only.
JAVA_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]").replace(r"(?!\S)", rf"(?![^{SPACES}])").replace(r"|\s+", rf"|[{SPACES}]+")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a public tokenizer's file lies: ``folder``, $TOKENIZERS, /opt/tokenizers or the installed package."""
    spec = importlib.util.find_spec("public_tokenizers")
    places = [folder, os.environ.get("TOKENIZERS"), "/opt/tokenizers", os.path.dirname(spec.origin) if spec and spec.origin else None]
    for place in filter(None, places):
        if os.path.exists(path := os.path.join(place, name)):
            return path
    raise FileNotFoundError(f"no {name} in {[p for p in places if p]}")


@functools.lru_cache(4)
def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(4)
def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@functools.lru_cache(4)
def pairs_of(data: bytes) -> dict[int, int]:
    """left id * 65536 + right id -> id of the two tokens' bytes together, wherever that is a token."""
    ranks = ranks_of(data)
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of 16 bits are expected")
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 16 | right] = rank
    return pairs


#: From this many characters on a word is encoded by our own heap, not by a library that may be quadratic in it.
SLOW = 256


class Encoder:
    """Encodes whole texts in Python: used where a text has long words, and for counting."""

    def __init__(self, data: bytes):
        import regex
        import tiktoken

        self.data, self.ranks = data, ranks_of(data)
        self.words = regex.compile(PATTERN)
        self.blanks, self.long = re.compile(rf"\s{{{SLOW}}}"), regex.compile(rf"\p{{L}}{{{SLOW}}}|\p{{N}}{{{SLOW}}}|[^\s\p{{L}}\p{{N}}]{{{SLOW}}}|\s{{{SLOW}}}")
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if (max(map(len, text.split()), default=0) < SLOW and not self.blanks.search(text)) or not self.long.search(text):
            return self.fast.encode_ordinary(text)
        return [i for word in self.words.findall(text) for i in self.word(word.encode())]

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        return pairs_of(self.data)

    def word(self, word: bytes) -> list[int]:
        """Merges the lowest rank first, leftmost first, with a heap: n log n in the word's length."""
        if word in self.ranks:
            return [self.ranks[word]]
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else len(ids)
            if j >= len(ids) or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (r := self.pairs.get(rank << 16 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := self.pairs.get(ids[h] << 16 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [i for i in ids if i >= 0]


@functools.lru_cache(2)
def encoder(data: bytes) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(data)
