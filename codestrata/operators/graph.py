"""Directed graphs as edge tables (src, dst): degrees, closure, chains, components.

Iterations keep only the frontier: each step joins the newly found rows with the
edges, removes what is known and checkpoints, so plans stay flat and the loss of
an executor costs one step. Edges are distinct and hash-partitioned by the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut


def edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def nodes(e: DataFrame) -> DataFrame:
    """Both ends of all edges; unknown ends are nodes too."""
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def display_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, r"\."), -1)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def degrees(e: DataFrame) -> DataFrame:
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("calls"))
    inn = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("called_by"))
    zero = F.lit(0).cast("bigint")
    return out.join(inn, "node", "full").select("node", F.coalesce("calls", zero).alias("calls"), F.coalesce("called_by", zero).alias("called_by"))


def entry_points(e: DataFrame) -> DataFrame:
    """Nodes that nobody calls."""
    return nodes(e).join(e.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(e: DataFrame) -> DataFrame:
    return nodes(e).join(e.select(F.col("src").alias("node")), "node", "left_anti")


def summary(e: DataFrame) -> DataFrame:
    d = degrees(e)
    return d.agg(
        F.count("*").alias("nodes"), F.sum("calls").alias("edges"), F.count_if(F.col("called_by") == 0).alias("entry_points"), F.count_if(F.col("calls") == 0).alias("leaves"),
        F.max("calls").alias("most_calls"), F.max("called_by").alias("most_callers"),
    )


def closure(e: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every dst reachable from src in one step or more; a node reaches
    itself only over a cycle. ``start`` (node) limits the sources."""
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("__n"))
    found = e if start is None else e.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    found = new = cut(found.select("src", "dst"))
    while True:
        new = cut(new.join(step, "dst").select("src", F.col("__n").alias("dst")).distinct().join(found, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        found = cut(found.unionByName(new))
    return found


# Condensed edges that go to every task as packed numbers, bytes of bits a task keeps.
PACKED_EDGES, BITS_BYTES = 4_000_000, 1 << 26


def _layers(n: int, src: np.ndarray, dst: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Edges of an acyclic graph of nodes 0 to n - 1 in slices of at most ``most``, each slice after all edges that leave its ends."""
    by_dst = np.argsort(dst, kind="stable")
    first = np.searchsorted(dst[by_dst], np.arange(n + 1))
    left, level, k = np.bincount(src, minlength=n), np.zeros(n, np.int64), 0
    now = np.flatnonzero(left == 0)
    while len(now):
        level[now] = k
        sizes = first[now + 1] - first[now]
        into = src[by_dst[np.repeat(first[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]]
        nodes_, times = np.unique(into, return_counts=True)
        left[nodes_] -= times
        now, k = nodes_[left[nodes_] == 0], k + 1
    order = np.lexsort((src, level[src]))
    src, dst = src[order], dst[order]
    ends = [0, *(np.flatnonzero(np.diff(level[src])) + 1).tolist(), len(src)]
    return src, dst, [(i, min(i + most, b)) for a, b in zip(ends, ends[1:], strict=False) for i in range(a, b, most)]


def reach_counts(e: DataFrame, packed_edges: int = PACKED_EDGES, bits_bytes: int = BITS_BYTES) -> DataFrame:
    """(src, reached): how many nodes each node reaches in one step or more, the sizes of the groups of :func:`closure`
    without its pairs.

    Members of a strongly connected component reach the same nodes, so only the acyclic graph of the components is
    followed, with a bit for every component: every task takes a block of targets and passes its bits against the
    edges once. Up to ``packed_edges`` edges between components are broadcast; of more the pairs of components are made.
    """
    comp = cut(components(e))
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("ca")), comp.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    between = cut(e.join(a, "src").join(b, "dst").select("ca", "cb").distinct())
    # a component reaches itself if it has an edge inside
    cyclic = between.where("ca = cb").select(F.col("ca").alias("component"), F.lit(True).alias("cyclic"))
    size = cut(comp.groupBy("component").agg(F.count("*").alias("size")).join(cyclic, "component", "left"))
    dag = between.where("ca <> cb")
    n_edges = dag.count()
    if n_edges > packed_edges:
        pairs = closure(dag.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        far = pairs.join(size.select(F.col("component").alias("dst"), "size"), "dst").groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("far"))
    elif n_edges:
        far = _far_counts(dag, size, bits_bytes)
    else:
        far = size.select("component", F.lit(0).cast("bigint").alias("far")).where("false")
    total = F.coalesce("far", F.lit(0)) + F.when(F.col("cyclic"), F.col("size")).otherwise(0)
    each = size.join(far, "component", "left").select("component", total.cast("bigint").alias("reached")).where("reached > 0")
    return comp.join(each, "component").select(F.col("node").alias("src"), "reached")


def _far_counts(dag: DataFrame, size: DataFrame, bits_bytes: int) -> DataFrame:
    """(component, far): nodes of all other components that each component of the acyclic ``dag`` (ca, cb) reaches."""
    spark = dag.sparkSession
    # numbered once: the numbers are kept by the checkpoint
    number = cut(nodes(dag.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))).join(size.select(F.col("component").alias("node"), "size"), "node").select("node", "size", F.monotonically_increasing_id().alias("no")))
    at = number.select("no", "size").toPandas().sort_values("no")
    no, weight = at["no"].to_numpy(), at["size"].to_numpy(np.float64)
    pairs = dag.join(number.select(F.col("node").alias("ca"), F.col("no").alias("s")), "ca").join(number.select(F.col("node").alias("cb"), F.col("no").alias("t")), "cb").select("s", "t").toPandas()
    n, width = len(no), 8 * max(1, min(-(-len(no) // 64), bits_bytes // (8 * len(no))))
    src, dst, slices = _layers(n, np.searchsorted(no, pairs["s"].to_numpy()), np.searchsorted(no, pairs["t"].to_numpy()), max(1, bits_bytes // width))
    shared = spark.sparkContext.broadcast((no, weight, src.astype(np.int32), dst.astype(np.int32), slices))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        no, weight, src, dst, slices = shared.value
        for first in (int(x) for pdf in batches for x in pdf["id"]):
            own = np.arange(first * width * 8, min((first + 1) * width * 8, n))
            bits = np.zeros((n, width), np.uint8)
            bits[own, (own - own[0]) // 8] = 128 >> ((own - own[0]) % 8)
            for i, j in slices:
                s = src[i:j]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                bits[s[starts]] |= np.bitwise_or.reduceat(bits[dst[i:j]].view(np.uint64), starts, axis=0).view(np.uint8)
            far, step = np.zeros(n), max(1, bits_bytes // (64 * width))
            w = np.zeros(width * 8)
            w[: len(own)] = weight[own]
            for i in range(0, n, step):
                far[i : i + step] = np.unpackbits(bits[i : i + step], axis=1) @ w
            far[own] -= weight[own]
            some = np.flatnonzero(far)
            yield pd.DataFrame({"no": no[some], "far": far[some].astype(np.int64)})

    blocks = -(-n // (width * 8))
    part = spark.range(0, blocks, 1, min(blocks, 10_000)).mapInPandas(run, "no long, far long").groupBy("no").agg(F.sum("far").alias("far"))
    return number.join(part, "no").select(F.col("node").alias("component"), "far")


def recursive(e: DataFrame) -> DataFrame:
    """Nodes on a cycle: members of a component of several nodes, or with an edge to themselves."""
    comp = components(e)
    big = comp.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    loops = e.where("src = dst").select(F.col("src").alias("node"))
    return comp.join(big, "component").select("node").unionByName(loops).distinct()


def chains(e: DataFrame, start: DataFrame, most_nodes: int | None = 10) -> DataFrame:
    """(src, dst, nodes, path): a shortest chain from every start to every node within
    ``most_nodes`` (all if None); among equally short ones the least path. One row per reached node and
    step, never all simple paths."""
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("__n"))
    new = start.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.array("node").alias("path")).distinct()
    found = new = cut(new)
    for _ in count() if most_nodes is None else range(most_nodes - 1):
        nxt = new.join(step, "dst").select("src", F.col("__n").alias("dst"), F.concat("path", F.array("__n")).alias("path"))
        nxt = nxt.groupBy("src", "dst").agg(F.min("path").alias("path"))
        new = cut(nxt.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        found = cut(found.unionByName(new))
    return found.select("src", "dst", F.size("path").alias("nodes"), "path")


def components(e: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their largest node.

    Forward colouring over the edges that may lie on a cycle: ends without a way in or out
    are trimmed, every node takes the largest node that reaches it, the nodes of a colour
    that reach its root backwards within the colour are a component, and edges between
    components fall away. What has no edges left is a component of its own. Only edges are
    kept from step to step, one checkpoint each; no all-pairs closure is made.
    """
    every = nodes(e)
    rest = cut(e.where("src <> dst"))
    done: DataFrame | None = None
    while True:
        size = rest.count()
        while size:  # trim: an edge stays if something leads to its start and away from its end
            starts, ends = rest.select(F.col("src").alias("dst")).distinct(), rest.select(F.col("dst").alias("src")).distinct()
            rest = cut(rest.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst"))
            before, size = size, rest.count()
            if size == before:
                break
        if not size:
            break
        colour = nodes(rest).select("node", F.col("node").alias("c"))
        while True:
            came = rest.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("m"))
            colour = cut(colour.select("node", "c").join(came, "node", "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.col("m") > F.col("c")).alias("moved")))
            if colour.where("moved").isEmpty():
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        inner = cut(rest.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
        member = cut(colour.where("node = c").select("node", "c", F.lit(True).alias("fresh")))
        while True:
            back = inner.join(member.where("fresh").select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c").distinct()
            both = member.select("node", "c", F.lit(1).alias("k")).unionByName(back.select("node", "c", F.lit(0).alias("k")))
            member = cut(both.groupBy("node", "c").agg((F.max("k") == 0).alias("fresh")))
            if member.where("fresh").isEmpty():
                break
        part = member.select("node", F.col("c").alias("component"))
        done = part if done is None else done.unionByName(part)
        gone = member.select("node")
        rest = cut(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    alone = every.select("node", F.col("node").alias("component"))
    return alone if done is None else done.unionByName(alone.join(done.select("node"), "node", "left_anti"))


def cycles(e: DataFrame) -> DataFrame:
    """(component, nodes, path): one cycle of every strongly connected component of several nodes, the shortest
    through its largest node (the least path of equally short ones), and every edge of a node to itself. The path
    ends where it begins."""
    comp = cut(components(e))
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("c")), comp.select(F.col("node").alias("dst"), F.col("component").alias("c"))
    inner = cut(e.where("src <> dst").join(a, "src").join(b, ["dst", "c"]).select(F.col("src").alias("at"), "dst", "c"))
    loops = e.where("src = dst").select(F.col("src").alias("component"), F.lit(1).alias("nodes"), F.array("src", "dst").alias("path"))
    new = cut(inner.select("c", F.col("c").alias("at"), F.array("c").alias("path")).distinct())
    seen = new.select("c", "at")
    done = loops
    while True:
        step = cut(new.join(inner, ["c", "at"]).select("c", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")).groupBy("c", "at").agg(F.min("path").alias("path")))
        back = step.where("at = c")
        done = done.unionByName(back.select(F.col("c").alias("component"), (F.size("path") - 1).alias("nodes"), "path"))
        new = cut(step.join(back.select("c"), "c", "left_anti").join(seen, ["c", "at"], "left_anti"))
        if new.isEmpty():
            return done
        seen = cut(seen.join(back.select("c"), "c", "left_anti").unionByName(new.select("c", "at")))


def has_cycles(e: DataFrame) -> bool:
    return not recursive(e).isEmpty()


def dependencies(e: DataFrame) -> DataFrame:
    """(node, direct): what each node depends on directly, sorted."""
    return e.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("direct"))


def dot_lines(e: DataFrame, highlight: DataFrame | None = None) -> DataFrame:
    """Lines of a DOT file; written as text they need no collecting."""
    e_lines = e.select(F.lit(1).alias("part"), F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))
    if highlight is None:
        return e_lines
    red = highlight.select(F.lit(0).alias("part"), F.format_string('  "%s" [color=red];', F.col("node").cast("string")).alias("line"))
    return red.unionByName(e_lines)
