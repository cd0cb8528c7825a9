"""Near-duplicate code: an exact size-aware similarity join.

A record's codes (new and old) become sets of hashed runs of four tokens. Equal
sets form one class, so a group of copies of any size is one element of the
join. Two classes are similar if common / distinct runs reach the threshold.

The join treats sets by size. A total order puts rare runs first. Their counts
come from a sketch over all runs; it is sized by the number of runs up to a fixed
bound and only ever counts too much, so order and cost may depend on it and the
result does not. A pair at threshold t shares at least o = ceil(t * size) runs, so
among the first size - o + k runs in this order both have at least k in common.

* Light sets enumerate all subsets of k = 2 of that beginning; a common subset
  is a candidate. Pairs that share a single, frequent run never meet.
* Heavy sets, whose subsets would be too many, scan the inverted lists of the
  runs of their beginning with k rising with the size and count how often a list
  names the same partner; light sets within reach of a heavy one by size put their runs into
  the lists as well.

The boundary between light and heavy is the size at which the whole join costs
least: for every size the rows and the expected partners of both ways are summed
over all sets, with the mean load of the sketch taken off its counts, so that the
boundary follows the real lengths of lists at any number of runs. Lists whose
counted length exceeds ``block`` are cut into blocks that meet pairwise in
separate groups, so a hot run never lands in one task; what the sketch cannot rule
out is counted exactly before. Candidates are verified on the whole sets; the
result is exact (up to 48-bit hashes of runs within a pair).

Defined results: null codes do not take part; a code of fewer than four tokens
has no runs and is similar to nothing; classes are named by a 128-bit hash;
repeated rows (same id) are one record; very long codes are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut, written

TOKEN = re.compile(r"\w+|[^\w\s]")
#: At most 2 ** 24 counters of two bytes (32 MB), whatever the number of runs.
SKETCH_BITS = (12, 24)
#: What meeting a partner in a list costs beside sending a row to it.
PARTNER_COST = 0.25


def shingles(code: str, n: int = 4) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the runs of n tokens."""
    tokens = TOKEN.findall(code)
    if len(tokens) < n:
        return np.zeros(0, np.int64)
    memo: dict[str, int] = {}
    h = np.array([memo[t] if t in memo else memo.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens], np.uint64)
    mix = np.zeros(len(tokens) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):  # a polynomial of the token hashes, finished by a bijective mix
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[i : len(tokens) - n + 1 + i]
            mix ^= mix >> np.uint64(29)
            mix *= np.uint64(0xBF58476D1CE4E5B9)
        mix ^= mix >> np.uint64(32)
    return np.unique((mix >> np.uint64(16)).view(np.int64))


def pack(runs: np.ndarray) -> bytes:
    """Six bytes for each run."""
    return runs.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes | memoryview) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<i8").ravel()


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a column of packed sets and where each set starts."""
    raw = col.to_pylist()
    return unpack(b"".join(raw)), np.concatenate(([0], np.cumsum([len(r) // 6 for r in raw]))).astype(np.int64)


def required(size: np.ndarray | int, t: float):  # noqa: ANN201
    """The least overlap of a set of this size with any similar set."""
    return np.maximum(1, np.ceil(np.asarray(size) * t - 1e-9)).astype(np.int64)


def heavy_k(size: np.ndarray | int):  # noqa: ANN201
    """How many common runs in their beginnings similar sets of lists must show: more for larger sets."""
    return 3 + np.asarray(size) // 24


def classes(df: DataFrame, key: str, codes: list[str], n: int = 4, broadcast_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(members: key, cls) and (sets: src, cls, size, runs), each class once; both written."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a class goes out once per task: copies are merged before the shuffle
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, cls, runs, sizes = [], [], [], []
                ids = part.column(0).to_pylist()
                for c in range(1, part.num_columns):
                    for k, code in zip(ids, part.column(c).to_pylist(), strict=True):
                        if code:
                            s = shingles(code, n)
                            if len(s):
                                name = xxhash.xxh128_digest(s.tobytes())
                                keys.append(k)
                                cls.append(name)
                                sizes.append(0 if name in seen else len(s))
                                runs.append(b"" if name in seen else pack(s))
                                if len(seen) < 1_000_000:
                                    seen.add(name)
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), pa.array(cls, pa.binary()), pa.array(sizes, pa.int32()), pa.array(runs, pa.binary())], ["k", "cls", "size", "runs"])

    table = df.select(key, *codes).mapInArrow(run, f"k {kind}, cls binary, size int, runs binary")
    table = written(table.withColumn("src", F.monotonically_increasing_id()), "neardup-sets")
    members = written(table.select(F.col("k").alias(key), "cls").distinct(), "neardup-members")
    # several tasks may have sent the same class: one of them is kept, chosen without moving the runs
    sent = table.where("size > 0")
    again = sent.groupBy("cls").agg(F.min("src").alias("keep"), F.collect_list("src").alias("all")).where(F.size("all") > 1)
    again = again.select(F.explode(F.array_remove("all", F.col("keep"))).alias("src"))
    few = again.count() <= broadcast_rows
    return members, sent.join(F.broadcast(again) if few else again, "src", "left_anti").select("src", "cls", "size", "runs")


def _sketch(sets: DataFrame, bits: int, tasks: int = 512) -> np.ndarray:
    """Counts of all runs by the low bits of their hash, up to 65,535: of bounded size, whatever the number of runs.

    At most ``tasks`` partial sketches are made; they travel compressed and in
    blocks, so what is shuffled and collected is bounded as well.
    """
    blocks, per, mask = 64, (1 << bits) // 64, (1 << bits) - 1
    schema = "block int, counts binary"

    def pack(total: np.ndarray) -> pa.RecordBatch:
        parts = [zlib.compress(total[i * per : (i + 1) * per].tobytes(), 1) for i in range(blocks)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(parts, pa.binary())], ["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                slot, n = np.unique(_flat(b.column(0).slice(at, 2048))[0] & mask, return_counts=True)
                total[slot] = np.minimum(total[slot] + n, 65535)
        yield pack(total.astype(np.uint16))

    def join(t: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for raw in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.uint16)
        packed = zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)
        return pa.table({"block": t.column("block").slice(0, 1), "counts": pa.array([packed], pa.binary())})

    rows = sets.select("runs").coalesce(tasks).mapInArrow(count, schema).groupBy("block").applyInArrow(join, schema).toLocalIterator()
    out = np.zeros(1 << bits, np.uint16)
    for r in rows:
        out[r.block * per : (r.block + 1) * per] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint16)
    return out


class Ordered:
    """The sets of a part of a batch (src, size, runs), each with its rare runs first, laid end to end."""

    def __init__(self, batch: pa.RecordBatch, freq: np.ndarray):
        runs, off = _flat(batch.column(2))
        self.name, self.size, self.start = batch.column(0).to_numpy(), np.diff(off), off[:-1]
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        count = freq[runs & (len(freq) - 1)].astype(np.int64)
        order = np.argsort(self.of << 16 | count, kind="stable")  # runs of a set come sorted: ties fall by run
        self.runs, self.count = runs[order], count[order]
        self.rank = np.arange(len(runs)) - np.repeat(self.start, self.size)

    @staticmethod
    def of_batch(batch: pa.RecordBatch, freq: np.ndarray, rows: int = 2048) -> Iterator[Ordered]:
        for at in range(0, batch.num_rows, rows):
            yield Ordered(batch.slice(at, rows), freq)


def beginning(size: np.ndarray, t: float) -> np.ndarray:
    """How many rare runs of a set of each size go into lists."""
    need = required(size, t)
    return size - need + np.minimum(heavy_k(size), need)


def subset_rows(size: np.ndarray, t: float) -> np.ndarray:
    """How many subsets of two (single runs where a pair may share one only) a set of each size enumerates."""
    need = required(size, t)
    begin = size - need + 1
    return np.where(need < 2, begin, (begin + 1) * begin // 2)


def _boundary(sets: DataFrame, t: float, shared: Broadcast, load: float) -> int:
    """The largest light size, 0 for none: where the sum of all costs is least.

    A subset costs its row; a place in a list its row and its expected partners. Light
    sets that a heavy one may reach by size pay for both.
    """
    schema = "size int, n bigint, partners double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        partners: dict[int, float] = {}
        for batch in batches:
            for o in Ordered.of_batch(batch, shared.value):
                listed = o.rank < beginning(o.size, t)[o.of]
                real = np.maximum(o.count - load, 1) - 1
                met = np.bincount(o.of, weights=real * listed, minlength=len(o.size))
                for size in np.unique(o.size):
                    here = o.size == size
                    n[int(size)] = n.get(int(size), 0) + int(here.sum())
                    partners[int(size)] = partners.get(int(size), 0.0) + float(met[here].sum())
        keys = sorted(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([n[k] for k in keys], pa.int64()), pa.array([partners[k] for k in keys], pa.float64())], ["size", "n", "partners"])

    # one row for each size that occurs
    hist = sets.select("src", "size", "runs").mapInArrow(work, schema).groupBy("size").agg(F.sum("n").alias("n"), F.sum("partners").alias("partners")).orderBy("size").toPandas()
    if not len(hist):
        return 0
    size, n = hist["size"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    light = np.concatenate(([0], np.cumsum(n * subset_rows(size, t).astype(float))))
    heavy = np.concatenate(([0], np.cumsum(n * beginning(size, t) + PARTNER_COST * hist["partners"].to_numpy())))
    last = np.concatenate(([0], size))
    reach = np.searchsorted(size, t * (last + 1) - 1e-9)  # the first light size that a heavy set may be like
    total = light + heavy[-1] - heavy[np.minimum(reach, np.arange(len(last)))]
    return int(last[int(total.argmin())])


def _pairs_of_groups(cols: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, need) of the pairs within equal keys; keys are sorted. need: meetings a pair must have.

    meta = 8 * size + 2 * kind + side; blocks that meet another block pair across the sides only.
    """
    key, src, meta, xy = cols
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    out_a, out_b, out_n = [], [], []
    for m in np.unique(sizes):
        if m < 2:
            continue
        i, j = np.triu_indices(m, 1)
        heads = starts[sizes == m]
        step = max(1, 4_000_000 // len(i))
        for at in range(0, len(heads), step):
            base = heads[at : at + step]
            x, y = (base[:, None] + i).ravel(), (base[:, None] + j).ravel()
            sx, sy, kx, ky = meta[x] >> 3, meta[y] >> 3, meta[x] >> 1 & 3, meta[y] >> 1 & 3
            small, large = np.minimum(sx, sy), np.maximum(sx, sy)
            keep = (src[x] != src[y]) & (xy[x] == xy[y]) & ((xy[x] >> 32 == (xy[x] & 0xFFFFFFFF)) | ((meta[x] ^ meta[y]) & 1 == 1))
            keep &= (small >= t * large - 1e-9) & ((kx == 0) == (ky == 0)) & ((kx == 0) | (kx + ky > 2))
            x, y = x[keep], y[keep]
            out_a.append(np.minimum(src[x], src[y]))
            out_b.append(np.maximum(src[x], src[y]))
            out_n.append(np.where(kx[keep] == 0, 1, np.minimum(heavy_k(small[keep]), required(small[keep], t))))
    if not out_a:
        z = np.zeros(0, np.int64)
        return z, z, z
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)


def candidates(sets: DataFrame, t: float, block: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """(a, b), a < b, once each: all pairs of sets (by ``src``) that may be similar."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = min(max(int(total).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    counts = _sketch(sets, bits)
    shared = spark.sparkContext.broadcast(counts)
    bound = _boundary(sets, t, shared, total / len(counts))
    post = signatures(sets, t, shared, bound, block)
    if (counts > block).any():
        # keys that the sketch cannot rule out are counted; longer lists are cut into blocks that meet pairwise
        hot = post.where("warm").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
        hot = written(hot, "neardup-hot")
        few = hot.count() <= broadcast_rows
        own, other = F.pmod(F.xxhash64("src"), F.col("parts")).cast("int"), F.col("other")
        post = post.join(F.broadcast(hot) if few else hot, "key", "left")
        cold = post.where("parts is null").select("key", "src", "meta", F.lit(0).cast("bigint").alias("xy"))
        split = post.where("parts is not null").select("key", "src", "meta", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        xy = F.shiftleft(F.least("own", other).cast("bigint"), 32).bitwiseOR(F.greatest("own", other).cast("bigint"))
        split = split.select("key", "src", (F.col("meta") + (other < F.col("own")).cast("int")).alias("meta"), xy.alias("xy"))
        post = cold.unionByName(split.select(F.xxhash64("key", "xy").alias("key"), "src", "meta", "xy"))
    else:
        post = post.select("key", "src", "meta", F.lit(0).cast("bigint").alias("xy"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each group; groups arrive sorted and whole and are at most some ``block`` long."""
        held: list[np.ndarray] | None = None
        for last, b in _with_end(batches):
            if b is not None and b.num_rows:
                cols = [b.column(i).to_numpy().astype(np.int64) for i in range(4)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if held is None or not len(held[0]):
                continue
            end = len(held[0]) if last else int(np.searchsorted(held[0], held[0][-1], "left"))  # the last group may go on
            if end:
                x, y, n = _pairs_of_groups([c[:end] for c in held], t)
                held = [c[end:] for c in held]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n.astype(np.int32))], ["a", "b", "need"])

    met = post.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint, need int")
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")


def signatures(sets: DataFrame, t: float, shared: Broadcast, bound: int, block: int) -> DataFrame:
    """(key, src, meta, warm): the keys under which each set meets others; ``warm`` where the
    sketch allows a list longer than ``block``. meta = 8 * size + 2 * kind."""
    mix_a, mix_b = np.int64(-7046029254386353131), np.int64(2862933555777941757)

    def emit(o: Ordered) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        # kind 0: subset of two, 1: list of a light set, 2: list of a heavy one
        need = required(o.size, t)
        is_light = o.size <= bound
        listed = (~is_light | (o.size >= t * (bound + 1) - 1e-9))[o.of] & (o.rank < beginning(o.size, t)[o.of])
        at = o.of[listed]
        yield o.runs[listed], o.count[listed], o.name[at], 8 * o.size[at] + np.where(is_light[at], 2, 4)
        single = (is_light & (need < 2))[o.of] & (o.rank < (o.size - need + 1)[o.of])  # a pair may share a single run only
        at = o.of[single]
        yield (o.runs[single] * mix_a) ^ np.int64(1), o.count[single], o.name[at], 8 * o.size[at]
        for size in np.unique(o.size[is_light & (need >= 2)]):  # equal sizes enumerate the same places
            rows = np.flatnonzero(o.size == size)
            x, y = np.triu_indices(int(size - required(size, t)) + 2, 1)
            x, y = (o.start[rows][:, None] + x).ravel(), (o.start[rows][:, None] + y).ravel()
            name = np.repeat(o.name[rows], len(x) // len(rows))
            yield (o.runs[x] * mix_a) ^ (o.runs[y] * mix_b + np.int64(7)), np.minimum(o.count[x], o.count[y]), name, np.full(len(x), 8 * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for o in Ordered.of_batch(batch, shared.value):
                    for key, count, name, meta in emit(o):
                        keep = count > 1  # the sketch never counts too little: a run counted once is in one set only
                        if keep.any():
                            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(name[keep]), pa.array(meta[keep].astype(np.int32)), pa.array(count[keep] > block)], ["key", "src", "meta", "warm"])

    return sets.select("src", "size", "runs").mapInArrow(run, "key bigint, src bigint, meta int, warm boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for b in batches:
        yield False, b
    yield True, None


def similar_classes(sets: DataFrame, t: float, block: int = 2000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(a, b, common, similarity) of all similar pairs of classes (by name).

    Candidates are verified around owners: the owner of a pair is the least number
    among the neighbours of its ends, so the versions of one text mostly share an
    owner and each set travels there once, not once per pair. Owners of more than
    ``block`` sets are cut into pairs of blocks.
    """
    pairs = written(candidates(sets, t), "neardup-candidates")
    ends = pairs.select("a", F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("o")))
    label = ends.groupBy(F.col("a").alias("n")).agg(F.least("n", F.min("o")).alias("l"))
    own = pairs.join(label.select(F.col("n").alias("a"), F.col("l").alias("la")), "a").join(label.select(F.col("n").alias("b"), F.col("l").alias("lb")), "b")
    own = own.select("a", "b", F.least("la", "lb").alias("owner"))
    size = own.select("owner", F.explode(F.array("a", "b")).alias("src")).distinct().groupBy("owner").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    own = own.join(size, "owner").select("a", "b", "owner", F.least(part("a"), part("b")).alias("x"), F.greatest(part("a"), part("b")).alias("y"))
    own = written(own, "neardup-owners")
    need = own.select("owner", "x", "y", F.explode(F.array("a", "b")).alias("src")).distinct()
    # the sets stay where they are while the list of wanted ones is small enough to be sent to them
    few = need.count() <= broadcast_rows
    moved = sets.join(F.broadcast(need) if few else need, "src").select(F.col("owner").alias("o"), F.col("x").alias("i"), F.col("y").alias("j"), "src", "cls", "runs")

    def verify(p: pa.Table, q: pa.Table) -> pa.Table:
        place = {k: i for i, k in enumerate(q.column("src").to_pylist())}
        flat, off = _flat(q.column("runs").combine_chunks())
        get = lambda i: flat[off[i] : off[i + 1]]
        names = q.column("cls").to_pylist()
        out: list[tuple[bytes, bytes, int, float]] = []
        for a, b in zip(p.column("a").to_pylist(), p.column("b").to_pylist(), strict=True):
            i, j = place[a], place[b]
            x, y = get(i), get(j)
            common = len(np.intersect1d(x, y, assume_unique=True))
            sim = common / (len(x) + len(y) - common)
            if sim >= t - 1e-12:
                out.append((names[i], names[j], common, sim))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"a": pa.array(cols[0], pa.binary()), "b": pa.array(cols[1], pa.binary()), "common": pa.array(cols[2], pa.int32()), "similarity": pa.array(cols[3], pa.float64())})

    return own.groupBy("owner", "x", "y").cogroup(moved.groupBy("o", "i", "j")).applyInArrow(verify, "a binary, b binary, common int, similarity double")


def found(df: DataFrame, key: str = "id", codes: tuple[str, ...] = ("new_code", "old_code"), t: float = 0.7, n: int = 4, block: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records with a similar code each."""
    members, sets = classes(df, key, list(codes), n)
    links = cut(similar_classes(sets, t).select("a", "b"))
    m = members.select("cls", F.col(key).alias("k"))
    x, y = m.withColumnRenamed("cls", "a").withColumnRenamed("k", "ka"), m.withColumnRenamed("cls", "b").withColumnRenamed("k", "kb")
    apart = links.join(x, "a").join(y, "b").select("ka", "kb")
    # copies of one code: every pair is a case by definition; large classes in pairs of blocks
    sizes = m.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    own = m.join(sizes, "cls").withColumn("p", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    left = own.select("cls", F.col("p").alias("x"), F.explode(F.sequence("p", F.col("parts") - 1)).alias("y"), F.col("k").alias("ka"))
    right = own.select("cls", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("x"), F.col("p").alias("y"), F.col("k").alias("kb"))
    same = left.join(right, ["cls", "x", "y"]).where("x < y or ka < kb").select("ka", "kb")
    pairs = apart.unionByName(same).where("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def membership(df: DataFrame, key: str = "id", codes: tuple[str, ...] = ("new_code", "old_code"), t: float = 0.7, n: int = 4) -> DataFrame:
    """One row per record and class of its codes: (key, cls, copies, links).

    ``copies`` counts the records of the class, ``links`` the other classes it is
    similar to; no pair of copies is expanded.
    """
    members, sets = classes(df, key, list(codes), n)
    links = cut(similar_classes(sets, t).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    copies = members.groupBy("cls").agg(F.count("*").alias("copies"))
    out = members.join(copies, "cls").join(degree, "cls", "left")
    return out.select(key, F.lower(F.hex("cls")).alias("cls"), "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
