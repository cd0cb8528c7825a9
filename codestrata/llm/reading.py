"""Reading level of English prose, 1 (easy) to 4 (for specialists).

Each document becomes a dozen numbers on syntax (sentence length and spread,
commas, subordination) and vocabulary (word and syllable lengths, shares of long
and of everyday words, variety). A linear ranker is fitted on pairs of graded
documents of different grade by logistic loss on the differences of their
features; isotonic regression of the grades on its scores then turns scores
into levels, so levels rise with scores and the cuts follow the graders' scale.

Only the fit is bounded: at most ``max_graded`` graded documents (those of the
smallest hash of their id) go to the driver as features, and ``max_pairs`` of
their pairs are drawn with a fixed seed. Features and levels cover every document
that qualifies, in one narrow pass.

Defined results: documents of other kinds or languages, and null or blank texts,
have no row; code fences, inline code, addresses and headings do not count as
prose, but a text of nothing else is judged as it stands; several grades of one
document are averaged; grades of unknown documents or outside 1 to 4 are
ignored; without two different grades there is no scale and the level is null;
repeated rows each give their row; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("guide", "design_note", "review", "release_note")
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|www\.\S+")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t].*$", re.M)
_MARK = re.compile(r"^[ \t]*(?:[-*+•>]|\d+[.)])[ \t]+", re.M)
_SENTENCE = re.compile(r"[.!?…。]+[\"')\]]*(?=\s|$)|\n\s*\n|[;:](?=\s)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyáéíóúäöü]+")
# English subordinators and connectives, and the most frequent function words.
_SUBORDINATE = frozenset("that which who whom whose when while whereas because although though unless until since if whether where before after so therefore however insofar notwithstanding whereby thereby irrespective provided".split())
_EVERYDAY = frozenset("the a an i you he she it we they me him her us them my your his its our their this that these those is are was were be been am do does did have has had can will would not no and or but to of in on at by for with from as up out then there here what how all one".split())
FEATURES = 13


def features(text: str) -> list[float]:
    body = _MARK.sub("", _HEADING.sub(" ", _INLINE.sub(" ", _FENCE.sub("\n\n", text.replace("\r\n", "\n")))))
    words = _WORD.findall(body)
    if not words:
        body, words = text, _WORD.findall(text)
    if not words:
        return [0.0] * FEATURES
    sizes = np.array([n for s in _SENTENCE.split(body) if (n := len(_WORD.findall(s)))] or [len(words)], float)
    low = [w.lower() for w in words]
    length = np.array([len(w) for w in low], float)
    beats = np.array([max(1, len(_VOWELS.findall(w))) for w in low], float)
    n = len(words)
    return [
        float(sizes.mean()),
        float(np.median(sizes)),
        float(np.log(sizes.mean())),
        float(sizes.std() / sizes.mean()),
        float(length.mean()),
        float(np.median(length)),
        float((length >= 7).mean()),
        float((length >= 10).mean()),
        float(beats.mean()),
        float((beats >= 4).mean()),
        sum(w in _EVERYDAY for w in low) / n,
        sum(w in _SUBORDINATE for w in low) / len(sizes),
        body.count(",") / len(sizes),
    ]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising fit of y on x as (sorted x, fitted y)."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order].astype(float)
    mean: list[float] = []
    size: list[int] = []
    for v in ys:
        mean.append(float(v))
        size.append(1)
        while len(mean) > 1 and mean[-2] >= mean[-1]:
            b, nb = mean.pop(), size.pop()
            mean[-1] = (mean[-1] * size[-1] + b * nb) / (size[-1] + nb)
            size[-1] += nb
    return xs, np.repeat(mean, size)


class Ranker:
    def __init__(self, x: np.ndarray, y: np.ndarray, max_pairs: int = 200_000, ridge: float = 1e-3, seed: int = 7):
        self.mid = x.mean(0)
        self.scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = (x - self.mid) / self.scale
        rng = np.random.default_rng(seed)
        n = len(y)
        if n * (n - 1) // 2 <= max_pairs:
            a, b = np.triu_indices(n, 1)
        else:
            a, b = rng.integers(0, n, (2, max_pairs))
        keep = y[a] != y[b]
        a, b = a[keep], b[keep]
        d = (z[a] - z[b]) * np.sign(y[a] - y[b])[:, None]
        weight = np.abs(y[a] - y[b])
        w = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps of the regularised logistic loss
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = -(d * (weight * p)[:, None]).mean(0) + ridge * w
            curve = (d * (weight * p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        self.knots, self.levels = isotonic(self.score(x), y)

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mid) / self.scale) @ self.w

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(np.interp(self.score(x), self.knots, self.levels) + 0.5), 1, 4).astype(int)


def qualifies(kind: Column, lang: Column, text: Column) -> Column:
    english = F.lower(F.trim(lang)).rlike(r"^(en|eng|english)([-_].*)?$")
    return kind.isin(*KINDS) & english & text.isNotNull() & text.rlike(r"[^\s\p{Z}\p{Cf}]")


def fit(documents: DataFrame, grades: DataFrame, max_graded: int = 6000, max_pairs: int = 200_000) -> Ranker | None:
    """The ranker, fitted on at most ``max_graded`` graded documents that qualify."""
    mean = grades.where(F.col("level").between(1, 4)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("level").alias("grade"))
    # the bound is drawn before the join, so that only graded texts are read into Python
    mean = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_graded)
    docs = documents.where(qualifies(F.col("kind"), F.col("lang"), F.col("text"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"grade": pdf["grade"], "x": [features(t) for t in pdf["text"]]})

    rows = docs.join(F.broadcast(mean), "doc_id").select("grade", "text").mapInPandas(run, "grade double, x array<double>").toPandas()
    if rows["grade"].nunique() < 2:
        return None
    # the order of rows varies from run to run; the fit must not
    x, y = np.array(rows["x"].tolist()), rows["grade"].to_numpy()
    order = np.lexsort((*x.T, y))
    return Ranker(x[order], y[order], max_pairs)


def levels(documents: DataFrame, grades: DataFrame, max_graded: int = 6000, max_pairs: int = 200_000) -> DataFrame:
    """(doc_id, level) of every document that qualifies."""
    model = fit(documents, grades, max_graded, max_pairs)
    docs = documents.where(qualifies(F.col("kind"), F.col("lang"), F.col("text"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("int").alias("level"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "level": model.level(x)})

    return docs.mapInPandas(run, "doc_id bigint, level int")
