"""The k most similar vectors of every vector, by vantage-point trees in shards.

Angles between unit vectors are a metric, so the triangle inequality prunes.

* Shards: at most ``max_pivots`` vectors (those of the smallest hash; the only
  fitted part) are pivots. Every vector is stored in the shard of its nearest
  pivot h. A vector x of shard c obeys d(x, c) <= d(x, h'), so one within r of a
  query q needs d(q, c) - d(q, h) <= 2 r; a query therefore visits exactly the
  shards within 2 r / ``factor`` of its nearest pivot, r being the distance of
  its (k+1)-th nearest pivot, which bounds that of its k-th neighbour.
* In a shard a vantage-point tree is built (split at the widest gap of the
  distances if there is one, else at the median) and searched by all visiting
  queries together; a side is skipped where |d(q, v) - mu| > r / ``factor``,
  with r the k-th best so far.

``factor = 1`` restores exact search; the default is chosen for a recall of well
over 0.9 (measured in the tests and the README). All vectors are indexed and all
are queries. Shards above ``shard_rows`` are split, queries in blocks, so no
task grows with a dense region. Vectors are kept in half precision, which moves
cosines by some 1e-5 (in full precision if ``factor`` <= 1).

Equal vectors are one element of the search, whatever their number, and expand
to their smallest ids only: k of them are all that any row can need.

Defined results: null vectors, other lengths than ``dim``, NaN, infinities and
zero vectors do not take part, neither as query nor as neighbour; ties of the
cosine go by the smaller id; with fewer than k other usable rows all of them are
neighbours; other columns are not read; a repeated id counts as one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut, written


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


class VPTree:
    """Vantage-point tree over unit vectors, searched by many queries at once."""

    def __init__(self, x: np.ndarray, leaf: int = 48):
        self.x = x
        self.leaf = leaf
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) > self.leaf:
            v = rows[0]
            d = angle(self.x[rows] @ self.x[v])
            s = np.sort(d)
            lo, hi = 1, len(s) - 1
            gaps = s[lo + 1 : hi + 1] - s[lo:hi]
            g = int(gaps.argmax()) if len(gaps) else 0
            mu = float(s[lo + g] + gaps[g] / 2) if len(gaps) and gaps[g] > 0.12 else float(s[len(s) // 2])
            inside = d <= mu
            if 0 < inside.sum() < len(rows):
                # the inner side is small after a gap; the outer one is walked by the loop of the search
                self.nodes[at] = ("split", v, mu, self._build(rows[inside]), self._outer(rows[~inside]))
                return at
        self.nodes[at] = ("leaf", rows)
        return at

    def _outer(self, rows: np.ndarray) -> int:
        return self._build(rows) if len(self.nodes) < 400 else self._leaf(rows)

    def _leaf(self, rows: np.ndarray) -> int:
        self.nodes.append(("leaf", rows))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, rows) of the k best of each query, -2 and -1 where there are fewer."""
        best = np.full((len(q), k), -2.0, np.float32)
        row = np.full((len(q), k), -1, np.int64)
        stack: list[tuple[int, np.ndarray, np.ndarray | None, float]] = [(self.root, np.arange(len(q)), None, 0.0)]
        while stack:
            at, who, dist, mu = stack.pop()
            if dist is not None:  # the far side: only who may still gain there
                r = angle(best[who, -1])
                keep = (np.abs(dist - mu) <= r / factor) | (best[who, -1] < -1)
                who = who[keep]
            if not len(who):
                continue
            node = self.nodes[at]
            if node[0] == "leaf":
                rows = node[1]
                sims = q[who] @ self.x[rows].T
                cos = np.concatenate((best[who], sims), 1)
                ids = np.concatenate((row[who], np.broadcast_to(rows, sims.shape)), 1)
                top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                c = np.take_along_axis(cos, top, 1)
                order = np.argsort(-c, axis=1, kind="stable")
                best[who] = np.take_along_axis(c, order, 1)
                row[who] = np.take_along_axis(np.take_along_axis(ids, top, 1), order, 1)
                continue
            _, v, m, inner, outer = node
            d = angle(q[who] @ self.x[v])
            near = d <= m
            for side, first, second in ((near, inner, outer), (~near, outer, inner)):
                if side.any():  # the stack is last in, first out: the near side goes on top
                    stack.append((second, who[side], d[side], m))
                    stack.append((first, who[side], None, 0.0))
        return best, row


def _usable(df: DataFrame, key: str, vector: str, dim: int, kept: type) -> DataFrame:
    """(id, cls, vec): unit vectors as bytes and the 128-bit name of their direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            off = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)
            rows = np.flatnonzero((np.diff(off) == dim) & np.array(col.is_valid()))
            x = flat[off[rows][:, None] + np.arange(dim)].astype(np.float64) if len(rows) else np.zeros((0, dim))
            norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            rows, x = rows[good], (x[good] / norm[good][:, None]).astype(np.float32)
            name = np.round(x * 1e6).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array([xxhash.xxh128_digest(r.tobytes()) for r in name], pa.binary()), pa.array([r.tobytes() for r in x.astype(kept)], pa.binary())], ["id", "cls", "vec"]
            )

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.size(vector) == dim).select(key, F.col(vector).cast("array<float>")).mapInArrow(run, f"id {kind}, cls binary, vec binary")


def _matrix(col: pa.Array, dim: int, kept: type) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kept).reshape(-1, dim).astype(np.float32)


def nearest(df: DataFrame, key: str = "id", vector: str = "embedding", k: int = 5, dim: int = 384, factor: float = 32.0, tree_factor: float | None = None,
            max_pivots: int = 4096, per_pivot: int = 600, shard_rows: int = 4096, block_rows: int = 16384, broadcast_rows: int = 500_000) -> DataFrame:
    """(key, rank, neighbour, cosine): the k nearest rows of every usable row."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    tree_factor = tree_factor or max(1.0, factor / 4)
    half = np.float16 if factor > 1 else np.float32
    rows = _usable(df, key, vector, dim, half).withColumn("rid", F.monotonically_increasing_id())
    rows = written(rows, "neighbours-rows")

    # equal vectors: the k + 1 smallest ids name the class, found without moving the vectors
    order = Window.partitionBy("cls").orderBy("id")
    small = rows.select("cls", "id", "rid").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    groups = small.groupBy("cls").agg(F.min_by("rid", "n").alias("rep"), F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    groups = written(groups, "neighbours-classes")
    doubles = rows.select("cls", "rid").join(groups.where(F.size("ids") > 1).select("cls", "rep"), "cls").where("rid <> rep").select("rid")

    n = groups.count()
    # the vectors stay where they are unless too many rows are copies
    few = rows.count() - n <= broadcast_rows
    reps = rows.join(F.broadcast(doubles) if few else doubles, "rid", "left_anti")
    if n == 0:
        return df.select(key, F.lit(0).alias("rank"), F.col(key).alias("neighbour"), F.lit(0.0).alias("cosine")).where("false")
    want = int(min(max_pivots, max(1, n // per_pivot)))
    pivots = _matrix(reps.select("vec", F.xxhash64("cls").alias("h"), "cls").orderBy("h", "cls").limit(want).toArrow().column("vec").combine_chunks(), dim, half)
    shared = spark.sparkContext.broadcast(pivots)  # at most max_pivots vectors

    def route(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = angle(x @ shared.value.T)
        home = d.argmin(1)
        base = d[np.arange(len(x)), home]
        if d.shape[1] <= k + 1:
            return home, np.ones_like(d, bool)
        r = np.partition(d, k, axis=1)[:, k]
        return home, d - base[:, None] <= (2 * r / factor)[:, None]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), 2), np.int64)
        for b in batches:
            if b.num_rows:
                home, visits = route(_matrix(b.column(0), dim, half))
                total[:, 0] += np.bincount(home, minlength=len(total))
                total[:, 1] += visits.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["c", "s", "v"])

    sizes = reps.select("vec").mapInArrow(load, "c int, s bigint, v bigint").groupBy("c").agg(F.sum("s").alias("s"), F.sum("v").alias("v")).toPandas().set_index("c").sort_index()
    subs = spark.sparkContext.broadcast(np.stack((-(-sizes["s"].to_numpy() // shard_rows), -(-sizes["v"].to_numpy() // block_rows)), 1).clip(1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = _matrix(b.column(2), dim, half)
                home, visits = route(x)
                low = np.array([int.from_bytes(c[:8], "little") >> 1 for c in b.column(1).to_pylist()], np.int64)
                out: list[tuple[int, int, int, bool, int]] = []
                for i, h in enumerate(home.tolist()):
                    s, q = subs.value[h]
                    out += [(h, int(low[i] % s), j, False, i) for j in range(q)]
                for i, c in zip(*np.nonzero(visits), strict=True):
                    s, q = subs.value[c]
                    out += [(int(c), j, int(low[i] % q), True, i) for j in range(s)]
                raw = b.column(2).to_pylist()
                cell, sub, blk, query, src = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(sub, pa.int32()), pa.array(blk, pa.int32()), pa.array(query), b.column(0).take(pa.array(src)), pa.array([raw[i] for i in src], pa.binary())],
                    ["cell", "sub", "blk", "query", "id", "vec"],
                )

    def meet(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy()
        data, asks = t.filter(pa.array(~query)), t.filter(pa.array(query))
        schema = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64())), ("cos", pa.list_(pa.float32()))])
        if not data.num_rows or not asks.num_rows:
            return schema.empty_table()
        # rows reach a task in any order; the tree must not depend on it
        data = data.sort_by("id")
        x = _matrix(data.column("vec").combine_chunks(), dim, half)
        q = _matrix(asks.column("vec").combine_chunks(), dim, half)
        take = min(k + 1, len(x))
        cos, row = VPTree(x).search(q, take, tree_factor if factor > 1 else 1.0)
        ok = row >= 0
        ends = np.concatenate(([0], np.cumsum(ok.sum(1)))).astype(np.int32)
        near = data.column("id").combine_chunks().take(pa.array(row[ok]))
        return pa.Table.from_arrays([asks.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), near), pa.ListArray.from_arrays(pa.array(ends), pa.array(cos[ok]))], schema=schema)

    dealt = reps.select("rid", "cls", "vec").mapInArrow(deal, "cell int, sub int, blk int, query boolean, id bigint, vec binary")
    met = dealt.groupBy("cell", "sub", "blk").applyInArrow(meet, "id bigint, near array<bigint>, cos array<float>")
    # a query has at most (visited shards) x (k + 1) candidates
    pairs = F.transform(F.arrays_zip("near", "cos"), lambda z: F.struct((-F.round(z["cos"].cast("double"), 6)).alias("d"), z["near"].alias("near")))
    best = met.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k + 1).alias("best"))
    best = best.select("id", F.explode("best").alias("b")).select("id", F.col("b.d").alias("d"), F.col("b.near").alias("near"))
    best = cut(best.where("id <> near"))
    # back to rows: a class stands for its smallest ids, and its own are at cosine 1
    ids = groups.select(F.col("rep").alias("near"), "ids", "cls")
    other = best.join(ids.select("near", "ids"), "near").select("id", "d", F.explode("ids").alias("nb"))
    own = ids.where(F.size("ids") > 1).select(F.col("near").alias("id"), F.lit(-1.0).alias("d"), F.explode("ids").alias("nb"))
    lists = other.unionByName(own).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "nb"))), 1, k + 1).alias("l"))
    members = rows.select("cls", "id").join(ids.select("cls", F.col("near").alias("rep")), "cls")
    per_row = members.join(lists.withColumnRenamed("id", "rep"), "rep").select("id", F.filter("l", lambda z: z["nb"] != F.col("id")).alias("l"))
    per_row = per_row.select("id", F.posexplode(F.slice("l", 1, k)).alias("r", "z"))
    return per_row.select(F.col("id").alias(key), (F.col("r") + 1).alias("rank"), F.col("z.nb").alias("neighbour"), (-F.col("z.d")).alias("cosine"))


def found(df: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the 5 nearest of the other."""
    near = nearest(df)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
