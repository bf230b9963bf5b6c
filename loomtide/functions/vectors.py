"""Vector expressions in double precision, and blocked similarity kernels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomtide.operators.shared import cut

#: Rows of a block, which is one row of a packed table; a task multiplies a strip of one block with another block.
BLOCK, STRIP = 2048, 512
#: Least and most rows of a partition of blocks, and most entries of the best lists that a task keeps for one.
LEAST, PART, KEPT = 256, 1 << 16, 1 << 21
#: Rows of the batches that a task returns.
OUT = 1 << 16
_FOUND = "left_id long, right_id long, similarity double"


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _packed(df: DataFrame, tasks: int, most: int = PART) -> tuple[DataFrame, int, str]:
    """(ids, vectors, no): blocks of rows as bytes, in partitions of at most ``most`` rows, ``tasks`` of them where rows suffice.

    Rows are dealt once, whatever the number of blocks; null ids and vectors are left out.
    """
    kind = "f4" if isinstance(df.schema["vector"].dataType.elementType, FloatType) else "f8"
    rows = df.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>" if kind == "f4" else "array<double>").alias("vector"))
    n = rows.count()
    parts = max(1, -(-n // most), min(tasks, -(-n // LEAST)))

    def block(t: pa.Table) -> pa.RecordBatch:
        lists = t.column("vector").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        if len(set(np.diff(lists.offsets.to_numpy()).tolist())) > 1:
            raise ValueError("vectors differ in length")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
        return pa.RecordBatch.from_pydict({"ids": [t.column("id").to_numpy().tobytes()], "vectors": [flat.tobytes()]}, pa.schema([("ids", pa.binary()), ("vectors", pa.binary())]))

    def pack(batches):
        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.num_rows
            while size >= BLOCK:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, BLOCK))
                held, size = t.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield block(pa.Table.from_batches(held))

    blocks = rows.repartition(parts).mapInArrow(pack, "ids binary, vectors binary")
    return cut(blocks.withColumn("no", F.monotonically_increasing_id())), parts, kind


def _crossed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every block of ``a`` beside every block of ``b``: a task reads its two partitions of the packed tables, nothing is shuffled."""
    return a.toDF("l_ids", "l_vectors", "l_no").crossJoin(b.toDF("r_ids", "r_vectors", "r_no").hint("shuffle_replicate_nl"))


def _blocks(batches, left: str, right: str):
    """(number, ids, matrix) of both blocks of each row."""
    for b in batches:
        for k in range(b.num_rows):
            out = []
            for at, kind in ((0, left), (3, right)):
                ids = np.frombuffer(b.column(at)[k].as_buffer(), "i8")
                out.append((b.column(at + 2)[k].as_py(), ids, np.frombuffer(b.column(at + 1)[k].as_buffer(), kind).reshape(len(ids), -1)))
            yield out


def _true(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask with few true entries: eight at a time where it can be read so."""
    if mask.size % 8 or not mask.flags.c_contiguous:
        return np.flatnonzero(mask)
    flat = mask.ravel()
    near = (np.flatnonzero(flat.view("u8"))[:, None] * 8 + np.arange(8)).ravel()
    return near[flat[near]]


def _alike(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, floor, top: int | None = None, wanted=None):
    """(i, j, similarity), strip by strip of x, of rows with different ids that are at least ``floor(rows)`` alike.

    A product in single precision finds the candidates, with the most that its
    sums can be wrong to spare; their similarity is computed in double precision
    and has six digits.  With ``top``, rows that can't be among a row's best of
    this block may be left out; pairs that ``wanted(i, j)`` denies are, too.
    """
    if x.shape[1] != y.shape[1]:
        raise ValueError("vectors differ in length")
    with np.errstate(all="ignore"):
        reach = math.sqrt(np.square(x, dtype="f8").sum(1).max()) * math.sqrt(np.square(y, dtype="f8").sum(1).max())
        single = reach < 1e30
        x4, y4 = (x.astype("f4", copy=False), y.astype("f4", copy=False)) if single else (None, None)
    slack = 1e-6 + (x.shape[1] + 8) * 2.0**-23 * reach
    y8 = None
    shared = len(np.intersect1d(ids, others)) > 0
    for at in range(0, len(x), STRIP):
        rows = slice(at, min(at + STRIP, len(x)))
        least = floor(rows)
        same = ids[rows, None] == others[None, :] if shared else None
        dense = None
        if single:
            rough = x4[rows] @ y4.T
            if shared:
                rough[same] = -np.inf
            low = np.maximum(least - slack, np.finfo("f4").min).astype("f4")
            mask = rough >= low[:, None]
            n = np.count_nonzero(mask)
            if top is not None and rough.shape[1] > top and n > 4 * top * len(rough):
                best = np.partition(rough, -top, axis=1)[:, -top].astype("f8")
                mask = rough >= np.maximum(best - 2 * slack, low).astype("f4")[:, None]
                n = np.count_nonzero(mask)
            if not n:
                continue
        else:
            n = len(least) * len(y)
        if not single or n * 16 > mask.size:
            y8 = y.astype("f8") if y8 is None else y8
            with np.errstate(all="ignore"):
                dense = np.round(x[rows].astype("f8") @ y8.T, 6)
            if not single:
                mask = dense >= least[:, None] if same is None else (dense >= least[:, None]) & ~same
        i, j = np.divmod(_true(mask), mask.shape[1])
        if wanted is not None and len(i):
            held = wanted(at + i, j)
            i, j = i[held], j[held]
        if dense is not None:
            sim = dense[i, j]
        else:
            sim = np.round(np.einsum("ij,ij->i", x[at + i].astype("f8"), y[j].astype("f8")), 6)
        held = sim >= least[i]
        if held.any():
            yield at + i[held], j[held], sim[held]


def _batched(run, schema: str):
    """``run``, which gives tuples of arrays, as a function that gives Arrow batches of some OUT rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def wrapped(batches):
        held, size = [], 0
        for columns in run(batches):
            held.append(columns)
            size += len(columns[0])
            if size < OUT:
                continue
            yield from pa.table([np.concatenate(c) for c in zip(*held)], names).to_batches(OUT)
            held, size = [], 0
        if size:
            yield from pa.table([np.concatenate(c) for c in zip(*held)], names).to_batches(OUT)

    return wrapped


class _Best:
    """The best of each row of a block so far, by similarity, then id."""

    def __init__(self, ids: np.ndarray, top: int, threshold: float):
        self.ids, self.top, self.threshold = ids.copy(), top, threshold
        self.sim, self.id = np.full((len(ids), top), -np.inf), np.full((len(ids), top), np.iinfo("i8").max)
        self.new, self.size = [], 0

    def floor(self, rows: slice) -> np.ndarray:
        return np.maximum(self.sim[rows, -1], self.threshold)

    def add(self, i: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        held = (sim > self.sim[i, -1]) | (ids < self.id[i, -1])
        self.new.append((i[held], ids[held], sim[held]))
        self.size += np.count_nonzero(held)
        if self.size >= self.sim.size:
            self.settle()

    def settle(self) -> None:
        """Ranks what came since with what was kept; done when there is much, as each time costs a sort."""
        if not self.size:
            return
        i, ids, sim = (np.concatenate(c) for c in zip(*self.new))
        self.new, self.size = [], 0
        rows, i = np.unique(i, return_inverse=True)
        i = np.concatenate([i, np.repeat(np.arange(len(rows)), self.top)])
        ids, sim = np.concatenate([ids, self.id[rows].ravel()]), np.concatenate([sim, self.sim[rows].ravel()])
        order = np.lexsort((ids, -sim, i))
        i = i[order]
        order = order[np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i] < self.top]
        self.id[rows], self.sim[rows] = ids[order].reshape(-1, self.top), sim[order].reshape(-1, self.top)

    def found(self):
        self.settle()
        i, k = np.nonzero(self.sim > -np.inf)
        return self.ids[i], self.id[i, k], self.sim[i, k]


def similar(left: DataFrame, right: DataFrame, threshold: float | None = None, top: int | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of vectors (id, vector): at least ``threshold`` alike, the ``top`` best of each left row.

    Both sides are packed into blocks once, and a task multiplies the blocks of
    its partition of the left side with all those of the right, one pair at a
    time: neither side is collected, and what a task holds is two partitions of
    blocks and the best of its rows.  With ``top`` a row comes with more than its
    best only where several tasks saw it, so the caller ranks them.
    """
    least = -math.inf if threshold is None else threshold
    tasks = 3 * left.sparkSession.sparkContext.defaultParallelism
    a, n_a, x_kind = _packed(left, tasks, min(PART, max(1024, KEPT // (top or 1))))
    b, n_b, y_kind = (a, n_a, x_kind) if right is left else _packed(right, tasks)

    def above(batches):
        for (_, ids, x), (_, others, y) in _blocks(batches, x_kind, y_kind):
            for i, j, sim in _alike(x, y, ids, others, lambda rows: np.full(rows.stop - rows.start, least)):
                yield ids[i], others[j], sim

    def ranked(batches):
        best = {}
        for (no, ids, x), (_, others, y) in _blocks(batches, x_kind, y_kind):
            if no not in best and sum(b.sim.size for b in best.values()) > 2 * max(KEPT, 1024 * top):
                yield from (b.found() for b in best.values())
                best = {}
            if no not in best:
                best[no] = _Best(ids, top, least)
            mine = best[no]
            for i, j, sim in _alike(x, y, ids, others, mine.floor, top):
                mine.add(i, others[j], sim)
        yield from (b.found() for b in best.values())

    # pairs of partitions stand in the order of the left ones, so that a task gets all pairs of some of these
    return _crossed(a, b).coalesce(n_a if 3 * n_a >= tasks else tasks).mapInArrow(_batched(above if top is None else ranked, _FOUND), _FOUND)


def _halved(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Each pair of blocks of a table once, each block beside itself, too."""
    a, _, kind = _packed(vectors, math.isqrt(6 * vectors.sparkSession.sparkContext.defaultParallelism) + 1)
    return _crossed(a, a).where("l_no <= r_no"), kind


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) of vectors (id, vector) at least ``threshold`` alike, each pair once, the lesser id left."""
    crossed, kind = _halved(vectors)

    def above(batches):
        for (no, ids, x), (other, others, y) in _blocks(batches, kind, kind):
            later = (lambda i, j: i < j) if no == other else None
            for i, j, sim in _alike(x, y, ids, others, lambda rows: np.full(rows.stop - rows.start, threshold), wanted=later):
                yield np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j]), sim

    return crossed.mapInArrow(_batched(above, _FOUND), _FOUND)


class _Tied:
    """Groups of the rows of the blocks that a task has seen; a group is known by its first row."""

    def __init__(self):
        self.at, self.ids, self.root = {}, np.empty(0, "i8"), np.empty(0, "i8")

    def place(self, no: int, ids: np.ndarray) -> int:
        if no not in self.at:
            self.at[no] = len(self.ids)
            self.root = np.concatenate([self.root, np.arange(len(self.ids), len(self.ids) + len(ids))])
            self.ids = np.concatenate([self.ids, ids])
        return self.at[no]

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def found(self):
        """Each row tied to the least id of its group; rows that are tied to none are left out."""
        least = np.full(len(self.ids), np.iinfo("i8").max)
        np.minimum.at(least, self.root, self.ids)
        least = least[self.root]
        tied = self.ids != least
        return self.ids[tied], least[tied]


def ties(vectors: DataFrame, threshold: float) -> DataFrame:
    """(u, v): edges that tie the same groups as all pairs of vectors (id, vector) at least ``threshold`` alike.

    A task gives one edge for each row of its partitions at most, to the least id
    of the row's group there, however many pairs are alike.
    """
    crossed, kind = _halved(vectors)

    def tied(batches):
        groups = _Tied()
        for (no, ids, x), (other, others, y) in _blocks(batches, kind, kind):
            if len(groups.ids) > 4 * PART:
                yield groups.found()
                groups = _Tied()
            p, q = groups.place(no, ids), groups.place(other, others)
            apart = lambda i, j: groups.root[p + i] != groups.root[q + j]
            for i, j, _ in _alike(x, y, ids, others, lambda rows: np.full(rows.stop - rows.start, threshold), wanted=apart):
                groups.tie(p + i, q + j)
        yield groups.found()

    return crossed.mapInArrow(_batched(tied, "u long, v long"), "u long, v long")
