"""Hand-written, generated, minified, vendored or data blob: belief propagation over directory trees.

Every row shows signs (banners and licences in its comments, layout of lines,
shares of data, accessors alike, file name); a table gives the probability of
each value of a sign for each label, and their product is the row's evidence.
Directories are hidden nodes with the same five labels. A row's label depends on
its directory's and a directory's on its parent's; a telling name (``vendor``,
``gen``, ``dist``) makes the latter depend on the name more than on the parent.
On this tree sum-product messages go up level by level and down again, so a
row's belief combines its own evidence, the parent's and, through the parent,
the siblings'. All potentials are finite: no name and no banner settles a row
by itself. The tree has no cycles, hence one sweep up and one down are exact.

Up-going messages are sums of logarithms, so each level is one aggregation with
map-side combining: a directory with a third of all rows costs no more than any
other. A level moves five numbers for each directory, never the texts; the
texts are read once. There are as many levels as the deepest path has parts.

Defined results: null or blank texts and null paths are hand-written unless
their path says otherwise (a null path hangs under the root); several rows of
one path are siblings; repeated rows each give their row; very long texts are
read whole. Jobs run while the plan is built: one for each level, up and down.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut, written

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GEN, MIN, VEND, BLOB = range(5)
#: Share of each label before anything is known.
PRIOR = np.log([0.80, 0.06, 0.04, 0.07, 0.03])
#: P(child directory's label | parent directory's): a subdirectory is mostly of its parent's kind.
DIR_GIVEN_DIR = np.array([
    [0.977, 0.01, 0.006, 0.002, 0.005],
    [0.15, 0.80, 0.01, 0.02, 0.02],
    [0.15, 0.02, 0.78, 0.03, 0.02],
    [0.02, 0.01, 0.02, 0.94, 0.01],
    [0.20, 0.02, 0.02, 0.02, 0.74],
])
#: P(row's label | directory's): files vary more than directories.
ROW_GIVEN_DIR = np.log([
    [0.83, 0.05, 0.02, 0.07, 0.03],
    [0.05, 0.91, 0.01, 0.01, 0.02],
    [0.15, 0.02, 0.78, 0.03, 0.02],
    [0.02, 0.01, 0.03, 0.93, 0.01],
    [0.22, 0.02, 0.02, 0.02, 0.72],
])

# Directory names that say what a directory is for.
NAMES = {
    "vendored": ("node_modules", "third_party", "thirdparty", "third-party", "vendor", "pods", "site-packages", "bower_components", "jspm_packages", "carthage", "external", "extern", "deps"),
    "generated": ("gen", "generated", "__generated__", "autogen", "migrations"),
    "built": ("dist", "static", "public", "assets"),
}
#: What a directory of such a name is, whatever it lies in, and how much that counts beside its parent's kind.
NAMED = {
    "vendored": ([0.030, 0.004, 0.012, 0.950, 0.004], 0.9),
    "generated": ([0.350, 0.560, 0.010, 0.040, 0.040], 0.8),
    "built": ([0.600, 0.030, 0.300, 0.040, 0.030], 0.8),
}
#: One matrix for directories without a telling name, then one for each kind of name.
MATRICES = np.log(np.stack([DIR_GIVEN_DIR, *[w * np.array(p)[None, :] + (1 - w) * DIR_GIVEN_DIR for p, w in NAMED.values()]]))

#: P(value of a sign | label), one line for each value in the order of ``LABELS``; the values
#: of a sign exclude each other and add up to 1. A row's evidence is the product over its signs.
SIGNS: dict[str, dict[str, tuple[float, ...]]] = {
    "name": {
        "plain": (0.985, 0.740, 0.690, 0.950, 0.965),
        "tool": (0.013, 0.250, 0.010, 0.030, 0.030),
        "packed": (0.002, 0.010, 0.300, 0.020, 0.005),
    },
    "banner": {
        "none": (0.9745, 0.420, 0.950, 0.960, 0.965),
        "below": (0.024, 0.030, 0.025, 0.025, 0.020),
        "head": (0.0015, 0.550, 0.025, 0.015, 0.015),
    },
    "denial": {  # was generated once, is written by hand now
        "no": (0.980, 0.998, 0.998, 0.998, 0.998),
        "yes": (0.020, 0.002, 0.002, 0.002, 0.002),
    },
    "origin": {
        "none": (0.9448, 0.990, 0.925, 0.655, 0.990),
        "own": (0.054, 0.003, 0.005, 0.005, 0.003),
        "foreign": (0.0012, 0.007, 0.070, 0.340, 0.007),
    },
    "library": {
        "no": (0.998, 0.995, 0.850, 0.950, 0.995),
        "yes": (0.002, 0.005, 0.150, 0.050, 0.005),
    },
    "layout": {
        "narrow": (0.920, 0.800, 0.020, 0.880, 0.500),
        "wide": (0.0792, 0.190, 0.060, 0.110, 0.480),
        "tight": (0.0005, 0.006, 0.150, 0.006, 0.010),
        "dense": (0.0003, 0.004, 0.770, 0.004, 0.010),
    },
    "map": {
        "no": (0.9985, 0.995, 0.800, 0.995, 0.999),
        "yes": (0.0015, 0.005, 0.200, 0.005, 0.001),
    },
    "data": {
        "little": (0.9962, 0.830, 0.988, 0.992, 0.060),
        "some": (0.003, 0.020, 0.007, 0.005, 0.090),
        "most": (0.0008, 0.150, 0.005, 0.003, 0.850),
    },
    "table": {  # of a state machine: from a generator, not from a pen
        "no": (0.9996, 0.800, 0.999, 0.998, 0.993),
        "yes": (0.0004, 0.200, 0.001, 0.002, 0.007),
    },
    "accessors": {
        "few": (0.986, 0.560, 0.993, 0.978, 0.998),
        "some": (0.0125, 0.090, 0.005, 0.017, 0.0015),
        "alike": (0.0015, 0.350, 0.002, 0.005, 0.0005),
    },
}
_LOG = {sign: {v: np.log(p) for v, p in values.items()} for sign, values in SIGNS.items()}

_MARKS = re.compile(r"^[\s#/*;<!\-\"'%=>]+")
_BANNER = re.compile(
    r"(?:code (?:auto-?)?generated by|@generated\b|auto-?generated\b|automatically generated|this (?:file|code|module) (?:was|is|has been) (?:automatically |auto-?|machine )?generated|machine[- ]generated|generated (?:from|by|with|using|automatically)|(?:<|&lt;)?auto-generated"
    r"|output of \S+[.;,] (?:any |do not|manual|changes)|do not (?:edit|modify)|any manual change)",
    re.I,
)
_ONCE = re.compile(r"\b(?:not|never|once|was generated once|no longer) (?:auto-?)?generated|generated once|by hand since|written for|hand-?written", re.I)
_THIRD = re.compile(
    r"(?:vendored\b|snapshot of the \S+ (?:distribution|release)|local patches are not|bundled here|upstream: ?https?://|copied from https?://|taken from https?://|\(c\) (?:the )?\S+ (?:contributors|authors)|copyright (?:\(c\) )?(?:\d{4} )?(?:the )?\S+ (?:authors|contributors)|licensed under the terms|released under the \S+ licen[cs]e|SPDX-License-Identifier|[\w.-]+ v\d+\.\d+\.\d+$)",
    re.I,
)
_OWN = re.compile(r"\bteam\b.*\breview|all changes need review", re.I)
_LIB = re.compile(r"^/\*!|@(?:license|preserve)\b")
_ACCESSOR = re.compile(
    r"\b(?:get|set|has|clear|add)_?\w*\s*\([^)]*\)\s*(?:\{|:|=>)?\s*(?:return\b|this\.\w+\s*=|self\.\w+\s*=|$)|\bjspb\.|\._get\(\d|\b_field\(\d|_descriptor\b|\bReflectionMessage\b|func \(m \*\w+\) Get\w+\(\)|if m != nil \{|prototype\.(?:get|set)\w+|this\.f\d+\b|self\._?f\d+\b|number\s*[:=]\s*\d+|\btype=\d+, label=\d"
)
#: One of these stands in every line that ``_ACCESSOR`` matches.
_HINTS = ("get", "set", "has", "clear", "add", "jspb", "_field(", "_descriptor", "ReflectionMessage", "func (m ", "m != nil", "this.f", "self.f", "self._f", "number", "type=")
_DATA = re.compile(
    r"(?P<number>[\s\[({&]*(?:-?(?:0x)?[0-9a-fA-F]+(?:\.\d+)?(?:[eE][+-]?\d+)?[\s,;\])}|]+){4,}$)"
    r"|(?P<string>[\s(+]*[rbu]?[\"'`]?[A-Za-z0-9+/=_-]{48,}[\"'`]?[\s\\+,;)]*$)"
    r"|(?P<record>\s*(?:\{\"[^{}]*\},?|\[(?:[^\[\]]*,){2,}[^\[\]]*\],?|INSERT INTO .*;?|\([^()]*(?:,[^()]*){2,}\)[,;]|(?:[^,;\t]*[,;\t]){4,}[^,;\t]*)\s*$)",
    re.I,
)
#: What a line of data has at least: many separators, many digits or one long word.
_MAYBE_DATA = re.compile(r"(?:[,;\t|][^,;\t|]*){2}|(?:\d[^\d]*){4}|[A-Za-z0-9+/=_-]{48}|\{\"|INSERT", re.I)
_RUN = re.compile(r"[A-Za-z0-9+/=]{200,}")
_TABLE = re.compile(r"\b_?(?:TRANSITIONS?|ACTIONS?|GOTO|PARSE_?TABLE|YY\w+|LR_?TABLE|ACCEPT|PRODUCTIONS?)\b\s*(?::[^=]*)?(?:=|\[)|\bvar (?:transitions|actions|gotos)\b|int\[\]\[\] T\b|(?:Symbol|Parse|State|Action)Table\b", re.I)
_ADDRESS = re.compile(r"https?://\S+")
_PB_NAME = re.compile(r"(?:_pb2?(?:_grpc)?|\.pb|_generated|\.generated|\.g|\.gen|_gen|_stub|_tables|\.designer)\.\w+$", re.I)
_MIN_NAME = re.compile(r"[.-]min\.(?:js|css|mjs)$|\.(?:bundle|chunk)\.(?:js|css)$|\.[0-9a-f]{8,20}\.(?:js|css)$", re.I)
_MAP = re.compile(r"//[#@] sourceMappingURL=", re.I)
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|<!--|%|\"\"\"|\'\'\')")
#: Code that may stand before the opening comment ends: it says nothing yet.
_PREAMBLE = re.compile(r"\s*(?:package|import|from|using|use|require|#include|#pragma|<\?|\"use strict\"|'use strict')")
_OPEN = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_WORDS, _DIGITS = re.compile(r"[^\W\d_]+(?:_?[^\W_]+)*"), re.compile(r"\d+")
_LETTERS, _FIGURES = bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(48, 58))


def directory(path: Column) -> Column:
    """The directory of a path: one kind of separator, none doubled, no leading ``./`` or ``/``; '' is the root."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(?:\.?/)+", "")
    return F.regexp_replace(p, r"/?[^/]*$", "")


def named(directory_: Column) -> Column:
    """Which matrix of ``MATRICES`` a directory takes by its last name."""
    last = F.lower(F.element_at(F.split(directory_, "/"), -1))
    out = F.lit(0)
    for i, kind in enumerate(NAMED, 1):
        out = F.when(last.isin(*NAMES[kind]), i).otherwise(out)
    return out


def _comments(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """(comment line, whether it stands in the head of the file) of all lines that are comments."""
    head, close = True, ""
    for line in lines:
        text = line.lstrip()
        if close:
            yield line, head
            close = "" if close in text else close
        elif _COMMENT.match(line):
            yield line, head
            for mark, end in _OPEN.items():
                if text.startswith(mark) and end not in text[len(mark) :]:
                    close = end
        else:
            if head and (_BANNER.match(text) or _THIRD.match(text)):
                yield line, True  # a note without a comment mark, as in text formats
            head = head and bool(_PREAMBLE.match(line))


def _shares(code: str, lines: int) -> tuple[float, float]:
    """(share of space, share of signs) of the characters."""
    raw = code.encode("utf-8", "surrogatepass")
    size = len(code)
    letters, digits = len(raw) - len(raw.translate(None, _LETTERS)), len(raw) - len(raw.translate(None, _FIGURES))
    if len(raw) != size:
        beyond = [c for c in code if c > "\x7f"]
        letters, digits = letters + sum(map(str.isalpha, beyond)), digits + sum(map(str.isdigit, beyond))
    space = (code.count(" ") + code.count("\t") + lines) / size
    return space, 1 - letters / size - digits / size - space


def signs(path: str | None, code: str | None) -> dict[str, str]:
    """The value of every sign of a row; the whole text is read."""
    out = {sign: next(iter(values)) for sign, values in SIGNS.items()}
    base = re.split(r"[\\/]", path or "")[-1]
    if _MIN_NAME.search(base):
        out["name"] = "packed"
    elif _PB_NAME.search(base):
        out["name"] = "tool"
    code = (code or "").replace("\r\n", "\n").replace("\r", "\n")
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return out
    for raw, head in _comments(lines):
        body = _MARKS.sub("", raw)
        banner = bool(_BANNER.match(body))
        if _ONCE.search(body):
            out["denial"] = "yes" if head else out["denial"]
        elif banner:
            out["banner"] = "head" if head or out["banner"] == "head" else "below"
        if head:
            if _OWN.search(body):
                out["origin"] = "own"
            elif _THIRD.match(body) and len(body) < 200 and out["origin"] == "none":
                out["origin"] = "foreign"
            if _LIB.search(raw) and not banner:
                out["library"] = "yes"
    n, size = len(lines), len(code)
    if "://" in code:  # an address is no minified code
        lines = [x for x in (_ADDRESS.sub("", raw) for raw in lines) if x.strip()] or [""]
        code = "\n".join(lines)
        n, size = len(lines), max(1, len(code))
    # layout: minified code has long lines and hardly any space around its signs
    if max(map(len, lines)) >= 160:
        out["layout"] = "wide"
        dense = sum(len(x) for x in lines if len(x) > 300) / size
        space, marks = _shares(code, n)
        if dense > 0.4 and space < 0.09 and marks > 0.12:
            out["layout"] = "dense"
        elif dense > 0.5 and space < 0.12 and marks > 0.15:
            out["layout"] = "tight"
        if dense > 0.3 and _MAP.search(lines[-1]):
            out["map"] = "yes"
    # data: rows of numbers, long strings without words, records
    kinds, mass, missed = Counter(), 0, 0
    for x in lines:
        m = _DATA.match(x) if _MAYBE_DATA.search(x) else None
        if m:
            kinds[m.lastgroup] += 1
            mass += len(x)
        else:
            missed += 1
            if missed > 0.6 * n:  # too few are left to matter
                break
    numbers, rows = kinds["number"] / n, sum(kinds.values()) / n
    blank = len(_RUN.sub("", code)) if size > 400 else size
    if (rows > 0.75 and n >= 8 and mass > 500 or numbers > 0.6 and mass > 250) or size - blank > 0.6 * size and size > 400:
        out["data"] = "most"
    elif rows > 0.6 and mass > 1500:
        out["data"] = "some"
    if numbers > 0.4 and _TABLE.search(code):
        out["table"] = "yes"
    # accessors one like the other
    if n >= 6:
        access = sum(1 for x in lines if any(h in x for h in _HINTS) and _ACCESSOR.search(x)) / n
        if access > 0.25:
            shapes = Counter(_DIGITS.sub("0", _WORDS.sub("a", x.strip())) for x in lines)
            same = sum(c for c in shapes.values() if c >= 4) / n
            out["accessors"] = "alike" if same > 0.5 else "some" if same > 0.25 else "few"
    return out


def row_evidence(path: str | None, code: str | None) -> np.ndarray:
    """Logarithms of how well each label explains the signs of the row."""
    return np.sum([_LOG[sign][value] for sign, value in signs(path, code).items()], axis=0)


def _lse(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp over the last axis, stable."""
    top = x.max(-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(-1, keepdims=True)))[..., 0]


def pass_up(weights: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Messages of children with log weights (n, 5) to their parents; one matrix for all or one for each."""
    return _lse(weights[:, None, :] + (matrix if matrix.ndim == 3 else matrix[None]))


def pass_down(weights: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Messages of parents with log weights (n, 5) to their children."""
    return _lse(weights[:, None, :] + np.swapaxes(matrix if matrix.ndim == 3 else matrix[None], 1, 2))


def _five(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(5)]


def _doubles(prefix: str) -> str:
    return ", ".join(f"{c} double" for c in _five(prefix))


def _take(pdf: pd.DataFrame, prefix: str) -> np.ndarray:
    return pdf[_five(prefix)].to_numpy(float).reshape(-1, 5)


def beliefs(df: DataFrame, key: str = "id", path: str = "file_path", code: str = "new_code", propagate: bool = True) -> DataFrame:
    """(key, label, p_handwritten, ...): the most probable label of each row and all five probabilities.

    With ``propagate`` false every row is judged by its own signs alone (to measure what the tree adds).
    """
    kind = df.schema[key].dataType.simpleString()

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = np.array([row_evidence(p, c) for p, c in zip(pdf["p"], pdf["c"], strict=True)]).reshape(-1, 5)
            up = pass_up(e, ROW_GIVEN_DIR)
            yield pd.concat([pdf[["k", "d"]].reset_index(drop=True), pd.DataFrame(e, columns=_five("e")), pd.DataFrame(up, columns=_five("u"))], axis=1)

    def report(pdf: pd.DataFrame, f: np.ndarray) -> pd.DataFrame:
        p = np.exp(f - _lse(f)[:, None])
        out = pd.DataFrame({key: pdf["k"].to_numpy(), "label": np.array(LABELS)[p.argmax(1)] if len(p) else []})
        return pd.concat([out, pd.DataFrame(p, columns=[f"p_{x}" for x in LABELS])], axis=1)

    schema = f"{key} {kind}, label string, " + ", ".join(f"p_{x} double" for x in LABELS)
    rows = df.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(code).alias("c"), directory(F.col(path)).alias("d"))
    rows = rows.mapInPandas(evidence, f"k {kind}, d string, {_doubles('e')}, {_doubles('u')}")
    if not propagate:
        return rows.mapInPandas(lambda batches: (report(pdf, _take(pdf, "e") + PRIOR) for pdf in batches), schema)
    rows = written(rows, "provenance-rows")

    # up from the rows: one message per row, summed per directory before and after the shuffle
    direct = rows.groupBy("d").agg(*[F.sum(c).alias(c) for c in _five("u")])
    # every directory with all its ancestors; those without rows of their own get no direct message
    parts = F.split("d", "/")
    anc = direct.select(F.explode(F.when(F.col("d") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    )).alias("d")).distinct()
    tree = anc.join(direct, "d", "left").select(
        "d",
        named(F.col("d")).alias("named"),
        F.when(F.col("d") == "", -1).otherwise(F.size(F.split("d", "/")) - 1).alias("depth"),
        F.when(F.col("d").contains("/"), F.regexp_replace("d", "/[^/]*$", "")).otherwise("").alias("parent"),
        *[F.coalesce(f"u{i}", F.lit(0.0)).alias(f"b{i}") for i in range(5)],
    )
    tree = cut(tree)
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return df.select(key, F.lit(None).cast("string").alias("label"), *[F.lit(None).cast("double").alias(f"p_{x}") for x in LABELS])

    # up the tree: b is what is known at and below a node, m its message to the parent
    def rise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = _take(pdf, "b") + np.nan_to_num(_take(pdf, "c"))
            b -= b.max(1, keepdims=True) if len(b) else 0
            m = pass_up(b, MATRICES[pdf["named"].to_numpy(int)])
            yield pd.concat([pdf[["d", "parent", "named"]].reset_index(drop=True), pd.DataFrame(b, columns=_five("b")), pd.DataFrame(m, columns=_five("m"))], axis=1)

    # down the tree: g is what is known from all sides; the child's own message is taken out again
    def sink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = _take(pdf, "b") + pass_down(_take(pdf, "g") - _take(pdf, "m"), MATRICES[pdf["named"].to_numpy(int)])
            g -= g.max(1, keepdims=True) if len(g) else 0
            yield pd.concat([pdf[["d"]].reset_index(drop=True), pd.DataFrame(g, columns=_five("g"))], axis=1)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield report(pdf, _take(pdf, "e") + pass_down(_take(pdf, "g") - _take(pdf, "u"), ROW_GIVEN_DIR))

    done: list[DataFrame] = []
    above: DataFrame | None = None
    for depth in range(deepest, -2, -1):
        level = tree.where(F.col("depth") == depth)
        level = level.join(above, "d", "left") if above is not None else level.select("*", *[F.lit(0.0).alias(c) for c in _five("c")])
        level = cut(level.mapInPandas(rise, f"d string, parent string, named int, {_doubles('b')}, {_doubles('m')}"))
        above = level.groupBy(F.col("parent").alias("d")).agg(*[F.sum(f"m{i}").alias(f"c{i}") for i in range(5)])
        done.append(level)

    known = done[-1].select("d", *[(F.col(f"b{i}") + float(PRIOR[i])).alias(f"g{i}") for i in range(5)])
    total = known
    for level in reversed(done[:-1]):
        met = level.join(known.withColumnRenamed("d", "parent"), "parent")
        known = cut(met.mapInPandas(sink, f"d string, {_doubles('g')}"))
        total = total.unionByName(known)
    return rows.join(total, "d").mapInPandas(finish, schema)
