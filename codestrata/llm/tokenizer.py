"""Exact byte-level BPE of a whole corpus in time linear in the text.

Words (the vocabulary's split pattern) are encoded without a merge queue. The
bytes of a word become Latin-1 characters, an Aho-Corasick automaton over all
tokens gives the longest token at each position, and a left-to-right walk takes
it whenever it is compatible with the token before. Two adjacent tokens are
compatible when plain BPE over their joined bytes gives back exactly those two;
a sequence whose neighbours are all compatible is the one BPE itself produces,
so the result equals the merges bit for bit. If no token fits, the position is
marked dead and the walk steps back; every position dies at most once, hence
linear time. Compatibilities and finished words are memoised per worker.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are plain text; invalid surrogates cannot occur in Spark
strings; repeated rows stay repeated; other columns are not read. The memo of
words is emptied when it is full, which changes speed only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the split pattern of the byte-level vocabularies in public_tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII without the separators 1C to 1F, on which `re` and `regex` differ.
ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
ODD = re.compile(r"[^\x00-\x1b\x20-\x7f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> id (= merge rank) from a file of base64 tokens and ranks."""
    lines = (x.split() for x in Path(path).read_bytes().splitlines() if x.strip())
    return {base64.b64decode(a): int(b) for a, b in lines}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memo: int = 1_000_000):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = memo
        self.pattern = regex.compile(pattern)
        self.fast = pattern == PATTERN
        self.token = {i: b for b, i in ranks.items()}
        self.auto = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.auto.add_word(b.decode("latin-1"), (len(b), i))
        self.auto.make_automaton()
        self.shorter: dict[int, int] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: join the pair of lowest rank until none is left. Only for short joins."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= self.memo:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def next_shorter(self, t: int) -> int:
        """The longest token that is a proper prefix of t, or -1. Such as plain BPE keeps whole."""
        if (s := self.shorter.get(t)) is None:
            b, s = self.token[t], -1
            for n in range(len(b) - 1, 0, -1):
                if (i := self.ranks.get(b[:n])) is not None:
                    s = i
                    break
            self.shorter[t] = s
        return s

    def word(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None and (len(data) < 3 or self.merge(data) == [whole] if len(data) <= 64 else False):
            return (whole,)
        n = len(data)
        longest = [-1] * n
        size = [0] * n
        for end, (length, i) in self.auto.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, i
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, cand = 0, longest[0]
        while pos < n or cand >= 0:
            if pos == n:
                break
            last = out[-1] if out else -1
            while cand >= 0:
                end = pos + len(self.token[cand])
                if alive[end] and (last < 0 or self.compatible(last, cand)):
                    break
                cand = self.next_shorter(cand)
            if cand >= 0:
                out.append(cand)
                pos = end
                cand = longest[pos] if pos < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                alive[pos] = 0
                cand = self.next_shorter(out.pop())
                pos -= len(self.token[last])
        return tuple(out)

    def encode(self, text: str, out: list[int]) -> None:
        words = self.words
        for w in ASCII.findall(text) if self.fast and ODD.search(text) is None else self.pattern.findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= self.memo:
                    words.clear()
                ids = self.word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    words[w] = ids
            out += ids


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row of ``df``; narrow, no shuffle.

    ``vocabulary`` is the path of a file of base64 tokens and ranks. It is read
    by the driver and broadcast: its size is that of one vocabulary, whatever
    the corpus.
    """
    known = read_vocabulary(vocabulary or default_vocabulary())
    ranks = df.sparkSession.sparkContext.broadcast(known)
    tag = (hashlib.sha256(repr(sorted(known.items())).encode()).hexdigest(), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one encoder for each worker process, kept for its later tasks
        enc = _ENCODERS.get(tag)
        if enc is None:
            _ENCODERS.clear()
            enc = _ENCODERS[tag] = Encoder(ranks.value, pattern)
        for batch in batches:
            ids: list[int] = []
            ends = [0]
            for t in batch.column(1):
                if (s := t.as_py()):
                    enc.encode(s, ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")
