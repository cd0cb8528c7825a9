"""Evaluation passages inside training documents, by an FM-index per shard.

Words are runs of letters and digits after compatibility folding (NFKC) and
removal of format characters, without case. Each task gathers documents into
shards. Words that no test item has become separators, and runs too short to
hold a passage are left out (they cannot match), which keeps the index small
without changing its answers. Over the rest the task builds a suffix array
(prefix doubling on the still tied suffixes), the Burrows-Wheeler transform and
a wavelet matrix; all test phrases of ``n`` words are searched backwards at
once through its ranks, and occurrences are located by walking to sampled
suffix positions. Separators sort by position, so suffixes never compare across
documents and a million copies of one text cost no extra rounds.

The phrases of the test items are made once, on the driver, as arrays of word
numbers in blocks of at most 200,000 (8 MB each), and broadcast; a task indexes a
shard once and searches block after block in it. After 20 blocks a further pass over
the corpus begins, so broadcasts stay bounded however many items there are. There
is no shuffle: a document's rows all come from its own task.

Defined results: null, empty and short texts leak nothing; items of fewer than
``n`` words cannot leak; an item that occurs several times in a document gives
one row; repeated document rows each give their rows; other columns are not
read. Spans are half open, in code points of the text from 0.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import written

WORD = re.compile(r"[^\W_]+")
FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]")
SAMPLE = 16


def words(text: str) -> list[str]:
    if not text.isascii():
        text = FORMAT.sub("", unicodedata.normalize("NFKC", text))
        return WORD.findall(unicodedata.normalize("NFKC", text.casefold()))
    return WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """The place of each of ``words(text)`` in the text itself.

    A stretch between characters that fold alone is folded at once, so that
    letters joined from several characters keep the place of all of them.
    """
    folded: list[str] = []
    at: list[tuple[int, int]] = []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or unicodedata.category(text[j]) == "Cf" or unicodedata.normalize("NFKC", text[i : j + 1]) != unicodedata.normalize("NFKC", text[i:j]) + unicodedata.normalize("NFKC", text[j])):
            j += 1
        piece = "".join(words_text(text[i:j]))
        folded.append(piece)
        at += [(i, j)] * len(piece)
        i = j
    return [(at[m.start()][0], at[m.end() - 1][1]) for m in WORD.finditer("".join(folded))]


def words_text(text: str) -> str:
    return unicodedata.normalize("NFKC", FORMAT.sub("", unicodedata.normalize("NFKC", text)).casefold())


class Wavelet:
    """Ranks over a sequence of small integers."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (seq >> b) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - one, dtype=np.int32)))
            self.levels.append((b, zeros, int(zeros[-1])))
            seq = np.concatenate((seq[one == 0], seq[one == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i, element by element."""
        lo, hi = np.zeros_like(i), i
        for b, zeros, total in self.levels:
            one = ((c >> b) & 1).astype(bool)
            zl, zh = zeros[lo], zeros[hi]
            lo, hi = np.where(one, total + lo - zl, zl), np.where(one, total + hi - zh, zh)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; zeros are separators, ordered by position and below all words."""
    n = len(text)
    seps = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(seps)
    key[seps] = np.arange(len(seps))
    sa = np.argsort(key, kind="stable")
    srt = key[sa]
    head = np.concatenate(([True], srt[1:] != srt[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        tied = ~(head & np.concatenate((head[1:], [True])))
        slots = np.flatnonzero(tied)
        if not len(slots):
            return sa
        rows = sa[slots]
        nxt = np.where(rows + k < n, rank[np.minimum(rows + k, n - 1)], -1)
        group = rank[rows]
        order = np.lexsort((nxt, group))
        rows, nxt, group = rows[order], nxt[order], group[order]
        sa[slots] = rows
        new = np.concatenate(([True], (nxt[1:] != nxt[:-1]) | (group[1:] != group[:-1])))
        head[slots] = new
        rank[rows] = np.maximum.accumulate(np.where(new, slots, 0))
        k *= 2


class Index:
    def __init__(self, text: np.ndarray, size: int):
        """text: word numbers from 1, with 0 before, between and after runs; size: one more than the largest."""
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.wave = Wavelet(self.bwt, max(1, int(size - 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))[:-1]
        # a walk goes left and never over a separator: the place after one is sampled too
        mark = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.mark, self.nth, self.samples = mark, np.cumsum(mark) - 1, sa[mark]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[c] + self.wave.rank(c, i)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all occurrences; phrases: one in each row."""
        who = np.arange(len(phrases))
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.bwt), np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[who, j]
            lo, hi = self.step(c, lo), self.step(c, hi)
            keep = hi > lo
            who, lo, hi = who[keep], lo[keep], hi[keep]
        count = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return np.repeat(who, count), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, todo, row = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(todo):
            done = self.mark[row]
            out[todo[done]] = self.samples[self.nth[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            row = self.step(self.bwt[row].astype(np.int64), row)
            steps += 1
        return out


class Phrases:
    """A block of runs of n words (numbers of the vocabulary) with the items that have each."""

    def __init__(self, rows: np.ndarray, items: np.ndarray):
        n = rows.shape[1]
        rows = np.ascontiguousarray(rows, np.int32)
        _, at, same = np.unique(rows.view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((same.ravel().astype(np.int64), items), 1), axis=0)
        self.rows, self.items = rows[at], pairs[:, 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(at))))).astype(np.int64)


def phrase_blocks(items: Iterable[tuple[int, str | None]], n: int, block: int, blocks: int) -> Iterator[tuple[dict[str, int], list[Phrases]]]:
    """(vocabulary, blocks of at most about ``block`` phrases) for each pass of at most ``blocks`` blocks."""
    ids: dict[str, int] = {}
    done: list[Phrases] = []
    rows: list[np.ndarray] = []
    whose: list[np.ndarray] = []
    size = 0

    def close() -> None:
        nonlocal size
        if rows:
            done.append(Phrases(np.concatenate(rows), np.concatenate(whose)))
            rows.clear()
            whose.clear()
            size = 0

    for item, text in items:
        w = words(text or "")
        for at in range(0, len(w) - n + 1, block):  # a very long item goes on in the next block
            part = np.array([ids.setdefault(x, len(ids) + 1) for x in w[at : at + block + n - 1]], np.int32)
            rows.append(np.lib.stride_tricks.sliding_window_view(part, n))
            whose.append(np.full(len(part) - n + 1, item, np.int64))
            size += len(part) - n + 1
            if size >= block:
                close()
        if len(done) >= blocks:  # an item stays within one pass
            yield ids, done
            ids, done = {}, []
    close()
    if done:
        yield ids, done


def _runs(seq: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least n words, with separators around; and where each place comes from."""
    word = np.concatenate(([0], (seq > 0).astype(np.int8), [0]))
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - start >= n
    start, length = start[keep], (end - start)[keep]
    total = int(length.sum()) + len(length) + 1
    off = np.concatenate(([0], np.cumsum(length + 1)))[:-1] + 1
    place = np.full(total, -1, np.int64)
    inner = np.repeat(start - off, length) + np.concatenate([np.arange(o, o + m) for o, m in zip(off, length, strict=True)]) if len(length) else np.zeros(0, np.int64)
    slots = inner - np.repeat(start - off, length)
    place[slots] = inner
    text = np.zeros(total, np.int64)
    text[slots] = seq[inner]
    return text, place


def search_shard(ids: list[list[int]], blocks: Iterable[Phrases], n: int, size: int) -> np.ndarray:
    """(document, item, word) of every occurrence in the documents of one shard: indexed once,
    every block of phrases is searched in it. ``size``: one more than the largest word number."""
    sizes = np.array([len(x) + 1 for x in ids], np.int64)
    ends = np.cumsum(sizes)
    seq = np.zeros(int(ends[-1]), np.int64)
    for x, e in zip(ids, ends, strict=True):
        seq[e - 1 - len(x) : e - 1] = x
    text, place = _runs(seq, n)
    found = [np.zeros((0, 3), np.int64)]
    if len(text) > 1:
        index = Index(text, size)
        for phrases in blocks:
            who, at = index.search(phrases.rows.astype(np.int64))
            at = place[at]
            doc = np.searchsorted(ends, at, side="right")
            at = at - (ends[doc] - sizes[doc])
            count = phrases.first[who + 1] - phrases.first[who]
            rows = np.repeat(phrases.first[who] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            found.append(np.stack((np.repeat(doc, count), phrases.items[rows], np.repeat(at, count)), 1) if len(who) else found[0])
    return np.concatenate(found)


def occurrences(documents: DataFrame, items: DataFrame, n: int = 10, shard_words: int = 1_000_000, block_phrases: int = 200_000, blocks: int = 20, spans: bool = False) -> DataFrame:
    """(doc_id, item_id) of all leaks; with ``spans`` also the merged spans of the item in the text.

    The phrases of the items go out in blocks; a shard is indexed once and the blocks pass by
    it one at a time. More than ``blocks`` blocks make a further pass over the corpus.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint" + ", spans array<struct<start:bigint,end:bigint>>" * spans
    out = None
    docs = documents.select(F.col("doc_id").cast("bigint"), "text").where("text is not null")
    rows = ((r[0], r[1]) for r in items.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator())
    for ids, parts in phrase_blocks(rows, n, block_phrases, blocks):
        vocabulary = spark.sparkContext.broadcast(ids)
        shared = [spark.sparkContext.broadcast(p) for p in parts]

        def run(batches: Iterator[pd.DataFrame], vocabulary=vocabulary, shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            get, size = vocabulary.value.get, len(vocabulary.value) + 1

            def passing() -> Iterator[Phrases]:
                for b in shared:
                    yield b.value
                    if len(shared) > 1:
                        b.__dict__.pop("_value", None)  # read again from its file for the next shard

            held: list[tuple[int, str | None]] = []
            nums: list[list[int]] = []
            many = 0
            for pdf in batches:
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    if text:
                        held.append((doc, text if spans else None))
                        nums.append([get(w, 0) for w in words(text)])
                        many += len(nums[-1])
                        if many >= shard_words:
                            yield _report(held, search_shard(nums, passing(), n, size), n, spans)
                            held, nums, many = [], [], 0
            if held:
                yield _report(held, search_shard(nums, passing(), n, size), n, spans)

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.mapInPandas(lambda batches: iter(()), schema) if out is None else out


def _report(docs: list, hit: np.ndarray, n: int, spans: bool) -> pd.DataFrame:
    keys = [d for d, _ in docs]
    if not spans:
        two = np.unique(hit[:, :2], axis=0)
        return pd.DataFrame({"doc_id": np.array([keys[i] for i in two[:, 0]], np.int64), "item_id": two[:, 1]})
    found = []
    order = np.lexsort((hit[:, 2], hit[:, 1], hit[:, 0]))
    place: tuple[int, list] = (-1, [])
    for d, item, w in hit[order].tolist():
        if place[0] != d:
            place = (d, word_spans(docs[d][1]))
        s, e = place[1][w][0], place[1][w + n - 1][1]
        if found and found[-1][3:] == (d,) and found[-1][1] == item:
            if s <= found[-1][2][-1]["end"]:
                found[-1][2][-1]["end"] = e
            else:
                found[-1][2].append({"start": s, "end": e})
        else:
            found.append((keys[d], item, [{"start": s, "end": e}], d))
    return pd.DataFrame([f[:3] for f in found], columns=["doc_id", "item_id", "spans"])


def removal_spans(documents: DataFrame, items: DataFrame, n: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, items, spans, clean): the leaked items of each document, the merged
    spans to remove and the text without them. Documents without leaks have no row.

    The spans of one document come from one task but from several items; they are
    merged per document, whose number of items is bounded by the test set.
    """
    hits = occurrences(documents, items, n, spans=True)
    grouped = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    grouped = written(grouped.withColumn("spans", merged), "leaks-spans")
    # texts stay where they are unless very many documents leak
    grouped = F.broadcast(grouped) if grouped.count() <= broadcast_rows else grouped
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, x: F.struct(F.concat(acc["t"], F.substring(F.col("text"), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int"))).alias("t"), x["end"].alias("at")),
        lambda acc: F.concat(acc["t"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))),
    )
    return documents.select(F.col("doc_id").cast("bigint"), "text").join(grouped, "doc_id").select("doc_id", "items", "spans", cut.alias("clean"))
