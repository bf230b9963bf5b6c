"""N-gram Jaccard join: size-aware, heavy and light sets apart, exact.

Documents with equal shingle sets form one class; classes are joined.

* Light (small) sets enumerate fixed-size subsets: the set itself and the
  subsets that lack one element.  Two light sets can link only if they share one.
* Heavy (large) sets are found through inverted lists.  A list is kept for each
  piece of the hashed shingle space rather than for each shingle: two linking
  sets differ in at most k shingles, so of k + 1 pieces one is equal in both.
  A list of single shingles of a shared passage would hold every document that
  has the passage; a list of pieces holds documents that agree in a whole piece.
  Pieces are taken over the shingles that aren't frequent (any subset of all
  shingles keeps the bound k).  A set of which more than k pieces have shingles
  lists only those; any other lists all its pieces over all shingles as well.
* The boundary is the largest size whose subsets cost no more than its lists.

A list of at most PAIRED members gives all its pairs.  The members of a longer
one are tied to its least member, first within a batch of documents, then over
all batches: n members give n - 1 ties, not n * n pairs, and the sets that are
tied, by whatever chain, are paired in blocks.  Each pair is first tried on the
parities of its sets: one bit for each of about as many buckets as a set has
shingles.  Buckets of unlike parity are no more than shingles that differ, so no
link is lost, and sets that share little more than a piece go, before chains of
them grow with the corpus.  What stays ties families, which are verified in
blocks on their whole shingle sets; the counts of direct links need all pairs of
a family's blocks, which travel compressed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm import textnum as tn
from loomtide.llm.components import components
from loomtide.llm.shared import bounded, drop, save, tidied

U = np.uint64
CLASS_RATIO = 1.4  # upper over lower size of a size class
BLOCK, MOST = 64, 512  # sets of a family that one verification block holds: more only where there are 64 blocks
BLOCK_SHINGLES = 1 << 20  # shingles that a block holds on average, or those of one set
#: Shingles count as frequent from this many sets on, as counted in runs of so many shingles; at most so many are told to the tasks.
FREQUENT, RUN, MAX_FREQUENT = 64, 2_000_000, 200_000
KEYS = 500_000  # list keys that a task combines before it hands them on
PAIRED = 32  # members of a list up to which all its pairs are told
SORTED = 100_000  # rows of lists that are read through at once
PARITY_BYTES = 1 << 22  # parities that are compared at once


def subset_depth(size: int, num: int, den: int) -> int:
    """Most elements that a set of ``size`` can lack in a linking set that is no larger."""
    deepest = 0
    for other in range(-(-num * size // den), size + 1):
        overlap = -(-num * (size + other) // (den + num))
        if overlap <= other:
            deepest = max(deepest, size - overlap)
    return deepest


def list_cost(size: int, num: int, den: int) -> float:
    """Piece keys of a set, and its elements, which verification reads."""
    return 2 * (size * (den - num) // num + 1) + size


def light_boundary(num: int, den: int) -> int:
    """Largest size that enumerates subsets; larger sets use inverted lists."""
    size = 0
    while True:
        depth = subset_depth(size + 1, num, den)
        if depth > 1 or sum(math.comb(size + 1, i) for i in range(depth + 1)) > list_cost(size + 1, num, den):
            return size
        size += 1


class Plan:
    """Sizes, classes and piece counts for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the threshold must lie between 0 and 1")
        self.num, self.den = num, den
        self.light = light_boundary(num, den)
        edges = [max(1, -(-num * (self.light + 1) // den))]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * CLASS_RATIO)))
        self.edges = np.array(edges, dtype=np.int64)
        #: Most shingles in which two linking sets of a class differ, and the pieces: so many that more than k have shingles in most sets.
        self.k = (self.edges[1:] - 1) * (den - num) // num
        self.pieces = np.array([self._pieces(int(low), int(k)) for low, k in zip(self.edges, self.k, strict=False)], dtype=np.int64)

    @staticmethod
    def _pieces(low: int, k: int) -> int:
        m = k + 1
        while m < 2 * (k + 1):
            empty = m * math.exp(-low / m)
            if m - empty - 2 * math.sqrt(empty) >= k + 1:
                break
            m += 1 + m // 50
        return m

    def groups(self, sizes: np.ndarray):
        """(rows, group) for each group of sizes that the rows belong to: their own, and smaller ones that reach up to them."""
        own = np.searchsorted(self.edges, sizes, side="right") - 1
        back = 0
        while True:
            g = own - back
            ok = (g >= 0) & (sizes > 0)
            if back:
                ok &= sizes * self.num < self.edges[np.maximum(g, 0) + 1] * self.den
            rows = np.flatnonzero(ok)
            if not len(rows):
                if back:
                    return
            else:
                yield rows, g[rows]
            back += 1


def set_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An id of each set, the same for equal sets (0 for the empty set)."""
    marks = tn.mix(tokens ^ U(0xA5A5A5A5A5A5A5A5))
    total = np.zeros(len(sizes), U)
    live = np.flatnonzero(sizes)
    if len(live):
        total[live] = np.add.reduceat(marks, (np.cumsum(sizes) - sizes)[live])
    return np.where(sizes > 0, tn.mix(total + sizes.astype(U) * U(0x9E3779B97F4A7C15)) | U(1), U(0))


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def list_keys(tokens: np.ndarray, sizes: np.ndarray, plan: Plan, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every inverted list that each set belongs to.  ``frequent``: sorted hashes of frequent shingles."""
    first = np.cumsum(sizes) - sizes
    marks = tn.mix(tokens + U(0x51ED270B7F651A2D))
    rare = ~_among(tokens, np.zeros(0, U) if frequent is None else frequent)
    keys, rows_out = [], []
    light = np.flatnonzero((sizes > 0) & (sizes <= plan.light))
    if len(light):
        n = sizes[light]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[light], n)
        own = np.add.reduceat(marks[at], np.cumsum(n) - n)
        grow = light[n * plan.den >= plan.num * (n + 1)]
        pos = np.searchsorted(light, grow)
        keys.append(tn.mix(own[pos] + n[pos].astype(U) * U(0xC2B2AE3D27D4EB4F)))
        rows_out.append(grow)
        less = (n - 1) * plan.den >= plan.num * n
        less |= (n - 1) * plan.den >= plan.num * (n + 1)
        each = np.repeat(less, n)
        keys.append(tn.mix(np.repeat(own, n)[each] - marks[at][each] + (np.repeat(n, n)[each] - 1).astype(U) * U(0xC2B2AE3D27D4EB4F)))
        rows_out.append(np.repeat(light, n)[each])
    for rows, group in plan.groups(np.where(sizes >= plan.edges[0], sizes, 0)):
        n, m, k = sizes[rows], plan.pieces[group], plan.k[group]
        total = int(m.sum())
        base = np.cumsum(m) - m
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)
        piece = ((tn.mix(tokens[at] ^ U(0x2545F4914F6CDD1D)) >> U(32)) * np.repeat(m, n).astype(U)) >> U(32)
        piece = piece.astype(np.int64) + np.repeat(base, n)
        owner = np.repeat(np.arange(len(rows)), m)
        number = tn.mix((np.arange(total) - np.repeat(base, m)).astype(U) + (np.repeat(group, m).astype(U) << U(40)))
        ask = np.ones(len(rows), bool)
        for tag, use in ((1, rare[at]), (2, np.ones(len(at), bool))):
            filled = np.bincount(piece[use], minlength=total) > 0
            enough = np.bincount(owner[filled], minlength=len(rows)) > k
            # over all shingles, a set with too few filled pieces lists its empty ones too
            out = ask[owner] & (filled if tag == 1 else filled | ~enough[owner])
            keys.append(tn.mix((tn.sums(marks[at][use], piece[use], total) ^ number) + U(tag))[out])
            rows_out.append(rows[owner[out]])
            ask = ask & ~enough
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows_out)


def parities(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each set's parities: a bit for each bucket, of which there are the power of two that holds the size, 64 at least."""
    width = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64), 0)
    stop = np.cumsum(width)
    bucket = (tn.mix(tokens ^ U(0x3C6EF372FE94F82B)) & np.repeat((np.maximum(width, 1) - 1).astype(U), sizes)).astype(np.int64)
    odd = np.bincount(bucket + np.repeat(stop - width, sizes), minlength=int(width.sum())) & 1
    return np.packbits(odd.astype(bool), bitorder="little"), np.concatenate([[0], stop]) // 8


def alike(data: np.ndarray, first: np.ndarray, wide: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs of sets (i, j) may link, by sizes and parities (of which ``data`` has ``wide`` bytes from ``first`` on); none that links is left out."""
    ok = np.minimum(sizes[i], sizes[j]) * den >= np.maximum(sizes[i], sizes[j]) * num
    swap = wide[i] > wide[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    kind = wide[i] << 32 | wide[j]
    for k in np.unique(kind[ok]):
        few, many = int(k) >> 32, int(k) & 0xFFFFFFFF
        if few == 0:
            continue
        rows, step = np.flatnonzero(ok & (kind == k)), max(1, PARITY_BYTES // many)
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            a = data[first[i[r], None] + np.arange(few)].view(U)
            b = data[first[j[r], None] + np.arange(many)].view(U)
            # half as many buckets: each bucket holds what two did
            b = np.bitwise_xor.reduce(b.reshape(len(r), many // few, few // 8), axis=1)
            differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            ok[r] = differ * (den + num) <= (sizes[i[r]] + sizes[j[r]]) * (den - num)
    return ok


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, off, data = column.cast(pa.large_binary()).buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def _sorted(keys: np.ndarray, nodes: np.ndarray):
    """Distinct (key, node) in order, each one's place in its key, and the place where its key begins."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    head = np.repeat(start, np.diff(np.append(start, len(keys))))
    return keys, nodes, np.arange(len(keys)) - head, head


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, v, _, _ = _sorted(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
    return u, v


def _count(run: list[np.ndarray], least: int = 8) -> pa.RecordBatch:
    """The shingles of a run that occur in several of its sets, as rows that stand for no document."""
    tok = np.concatenate(run)
    run.clear()
    tok.sort()  # in place, and only the few that occur so often are copied
    if len(tok) >= least:
        often = np.zeros(len(tok), bool)
        often[: len(tok) - least + 1] = tok[least - 1 :] == tok[: len(tok) - least + 1]
        often = np.unique(tok[often])
    else:
        often = tok[:0]
    tok, c = often, np.searchsorted(tok, often, side="right") - np.searchsorted(tok, often)
    none = pa.nulls(len(tok), pa.int64())
    return pa.record_batch([none, none, pa.array(c.astype(np.int64)), pa.array(tok.view(np.int64)), pa.array(np.ones(len(tok), bool)), pa.nulls(len(tok), pa.binary())], _SETS)


_SETS = ["doc_id", "digest", "size", "node", "frequent", "bits"]


def _read(width: int):
    """Over batches of (doc_id, digest, text): set id, size and parities of each row, and counts of frequent shingles."""

    def rows(batches):
        run, held = [], 0
        for b in batches:
            for at, rows_in, data, off in tn.chunks(b.column(2)):
                tok, n = tn.shingles(*tn.words(data, off), width)
                ids = set_ids(tok, n)
                seen = np.zeros(len(n), bool)
                seen[np.unique(ids, return_index=True)[1]] = True
                run.append(tok[np.repeat(seen, n)])
                held += len(run[-1])
                bits, at_bit = parities(tok, n)
                bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at_bit.astype(np.int32)), pa.py_buffer(bits)])
                yield pa.record_batch([b.column(0).slice(at, rows_in), b.column(1).slice(at, rows_in), pa.array(n), pa.array(ids.view(np.int64)), pa.array(np.zeros(len(n), bool)), bits], _SETS)
                if held >= RUN:
                    yield _count(run)
                    run, held = [], 0
        if run:
            yield _count(run)

    return rows


def _lists(plan: Plan, width: int, frequent):
    """Over batches of (text): rows (key, node, null) of each run's lists, and rows (null, least, other) of ties within it.

    Of a list, a run hands on the least members: so many that the whole list is told as a long one if they are not all.
    """

    def told(keys, nodes):
        key, node, place, head = _sorted(np.concatenate(keys), np.concatenate(nodes))
        few = place <= PAIRED
        u, v = _distinct([(node[head[~few]], node[~few])])
        return [
            pa.record_batch([pa.array(key[few].view(np.int64)), pa.array(node[few]), pa.nulls(int(few.sum()), pa.int64())], _LISTED),
            pa.record_batch([pa.nulls(len(u), pa.int64()), pa.array(u), pa.array(v)], _LISTED),
        ]

    def lists(batches):
        keys, nodes, held = [], [], 0
        for b in batches:
            for _, _, data, off in tn.chunks(b.column(0)):
                tok, n = tn.shingles(*tn.words(data, off), width)
                ids = set_ids(tok, n).view(np.int64)
                seen = np.zeros(len(n), bool)
                seen[np.unique(ids, return_index=True)[1]] = True
                keep = np.repeat(seen, n)
                k, r = list_keys(tok[keep], np.where(seen, n, 0), plan, frequent.value)
                keys.append(k)
                nodes.append(ids[r])
                held += len(k)
                if held >= KEYS:
                    yield from told(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield from told(keys, nodes)

    return lists


_LISTED = ["key", "u", "v"]


def _tied(batches, paired: int = 1):
    """Over rows of :func:`_lists` sorted by key, with any key for ties: each list's least node with its others, and the ties.

    A list of at most ``paired`` members gives all its pairs instead, the larger node first.  Only the least members of
    the last key are kept from batch to batch, so that a list may have any length.
    """
    key, node, rows, found, held = [], [], 0, [], 0

    def told():
        u, v = _distinct(found)
        return pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    def read(last):
        """Tells the lists that ended; the least members of the one that may go on are kept."""
        k, u, place, head = _sorted(np.concatenate(key), np.concatenate(node))
        n = np.bincount(head, minlength=len(k))[head]
        ended = last | (k != k[-1:]) | (place > paired)
        others = np.flatnonzero(ended & (n > paired) & (place > 0))
        found.append((u[head[others]], u[others]))
        short = np.flatnonzero(ended & (n <= paired))
        for d in range(1, paired):
            short = short[place[short] + d < n[short]]
            found.append((u[short + d], u[short]))
        return [k[~ended]], [u[~ended]]

    for b in batches:
        tie = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        k, u, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).fill_null(0).to_numpy()
        found.append((u[tie], v[tie]))
        key.append(k[~tie])
        node.append(u[~tie])
        rows += b.num_rows
        if rows >= SORTED:
            (key, node), held, rows = read(False), held + rows, 0
        if held + sum(len(u) for u, _ in found) >= KEYS:
            yield told()
            found, held = [], 0
    if key:
        read(True)
        yield told()


def _sieve(num: int, den: int):
    """Over batches of (u, v, size, bits, other_size, other_bits): the pairs (u, v) that may link."""

    def rows(batches):
        for b in batches:
            (x, at), (y, to) = _binary(b.column(3)), _binary(b.column(5))
            n = b.num_rows
            sizes = np.concatenate([b.column(2).to_numpy(), b.column(4).to_numpy()])
            first, wide = np.concatenate([at[:-1], to[:-1] + len(x)]), np.concatenate([np.diff(at), np.diff(to)])
            keep = alike(np.concatenate([x, y]), first, wide, sizes, np.arange(n), np.arange(n) + n, num, den)
            yield b.select([0, 1]).filter(pa.array(keep))

    return rows


def _sieved(num: int, den: int):
    """Ties of the sets of two blocks of a family that may link, or of one block."""

    def verify(table: pa.Table) -> pa.Table:
        node, block, sizes = (table.column(c).to_numpy() for c in ("node", "block", "size"))
        data, off = _binary(table.column("bits"))
        link = np.zeros((len(node), len(node)), bool)
        one = bool((block == block[0]).all())
        for i in range(len(node)):
            j = np.arange(i + 1, len(node))
            j = j if one else j[block[j] != block[i]]
            link[i, j] = alike(data, off[:-1], np.diff(off), sizes, np.full(len(j), i), j, num, den)
        label = _labels(link | link.T)
        other = label != np.arange(len(node))
        return pa.table({"u": node[label[other]], "v": node[other]})

    return verify


def link_matrix(tokens: list[np.ndarray], num: int, den: int, cut: int | None = None) -> np.ndarray:
    """Which of these sets link with which; with ``cut``, only those before it with those from it on."""
    n = len(tokens)
    sizes = np.array([len(t) for t in tokens], np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, inv = np.unique(np.concatenate(tokens), return_inverse=True)
    df = np.bincount(inv)
    a, b = (slice(0, n), slice(0, n)) if cut is None else (slice(0, cut), slice(cut, n))
    shared = np.full((n, n), float(np.count_nonzero(df == n)))[a, b]
    use = np.flatnonzero((df > 1) & (df < n))
    place = np.full(len(df), -1)
    place[use] = np.arange(len(use))
    col = place[inv]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col)
    row, col = row[order], col[order]
    step = 4096
    for at in range(0, len(use), step):
        i, j = np.searchsorted(col, [at, at + step])
        m = np.zeros((n, min(step, len(use) - at)), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        shared += m[a] @ m[b].T
    inter = np.rint(shared).astype(np.int64)
    return inter * den >= num * (sizes[a, None] + sizes[None, b] - inter)


class Block:
    """Sets of one family that are verified together."""

    def __init__(self, node, copies, tokens):
        self.node, self.copies, self.tokens = node, copies, tokens

    @staticmethod
    def of(table: pa.Table) -> Block:
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        packed = table.column("tokens")
        return Block(node, table.column("copies").to_numpy()[first], [np.frombuffer(packed[int(i)].as_py(), U) for i in first])

    def packed(self) -> bytes:
        """All arrays behind one another; near copies share most of their shingles, which the compression uses."""
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        raw = b"".join([np.int64(len(sizes)).tobytes(), self.node.tobytes(), self.copies.astype(np.int64).tobytes(), sizes.tobytes(), *(t.tobytes() for t in self.tokens)])
        return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)

    @staticmethod
    def unpacked(data: bytes) -> Block:
        raw = pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), "zstd", asbytes=True)
        ints = np.frombuffer(raw, np.int64)
        n = int(ints[0])
        node, copies, sizes = ints[1 : n + 1], ints[n + 1 : 2 * n + 1], ints[2 * n + 1 : 3 * n + 1]
        return Block(node, copies, np.split(ints[3 * n + 1 :].view(U), np.cumsum(sizes)[:-1]))


def _labels(link: np.ndarray) -> np.ndarray:
    """The least row reachable from each row by links."""
    label = np.arange(len(link))
    for i in range(len(link)):
        if label[i] == i:  # everything reachable from i that has no label yet
            reach = link[i].copy()
            reach[i] = True
            front = np.flatnonzero(link[i])
            while len(front):
                new = link[front].any(axis=0) & ~reach
                reach |= new
                front = np.flatnonzero(new)
            label[reach] = np.minimum(label[reach], i)
    return label


_FOUND = "node long, label long, links long"


def _found(node, link, weight) -> dict[str, np.ndarray]:
    label, keep = _labels(link), link.any(axis=0)
    return {"node": node[keep], "label": node[label[keep]], "links": (link @ weight)[keep].astype(np.int64)}


def _within(num: int, den: int):
    """Links inside a block and, where the family has more blocks, the block itself for the pairs with the others."""

    def verify(table: pa.Table) -> pa.Table:
        block, blocks = Block.of(table), table.column("blocks")[0].as_py()
        link = link_matrix(block.tokens, num, den)
        np.fill_diagonal(link, False)
        got = _found(block.node, link, block.copies)
        more = 1 if blocks > 1 else 0
        rest = {"family": pa.array([table.column("family")[0].as_py()] * more, pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * more, pa.int32()), "blocks": pa.array([blocks] * more, pa.int32()), "sets": pa.array([block.packed() for _ in range(more)], pa.binary())}
        n = len(got["node"])
        cols = {k: pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(more, pa.int64())]) for k, v in got.items()}
        return pa.table(cols | {k: pa.concat_arrays([pa.nulls(n, v.type), v]) for k, v in rest.items()})

    return verify


def _between(num: int, den: int):
    """Links between two blocks of a family."""

    def verify(table: pa.Table) -> pa.Table:
        a, b = (Block.unpacked(x.as_py()) for x in table.column("sets"))
        cut, n = len(a.node), len(a.node) + len(b.node)
        link = np.zeros((n, n), bool)
        link[:cut, cut:] = link_matrix([*a.tokens, *b.tokens], num, den, cut)
        link |= link.T
        return pa.table(_found(np.concatenate([a.node, b.node]), link, np.concatenate([a.copies, b.copies])))

    return verify


def _dealt(members: DataFrame, total: DataFrame) -> DataFrame:
    """The members of families with their block and the number of blocks."""
    rows = F.least(F.greatest(F.col("members") / F.lit(BLOCK), F.lit(BLOCK)), F.lit(MOST))
    blocks = F.greatest(F.ceil(F.col("members") / rows), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    side = members.join(bounded(total), "family").withColumn("blocks", blocks)
    return side.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _near(tied: DataFrame, parity: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of sets that may link: of the pairs of short lists those that pass the parities, and ties of those of long lists that do."""
    pairs = tied.where("u > v").distinct()
    pairs = pairs.join(parity.withColumnRenamed("node", "u").hint("merge"), "u")
    pairs = pairs.join(parity.select(F.col("node").alias("v"), F.col("size").alias("other_size"), F.col("bits").alias("other_bits")).hint("merge"), "v")
    pairs = pairs.select("u", "v", "size", "bits", "other_size", "other_bits").mapInArrow(tidied(_sieve(num, den)), "u long, v long")
    long = tied.where("u < v")
    if long.isEmpty():
        return save(pairs, "near")
    family = save(components(long), "chains")
    members = save(family.withColumnRenamed("label", "family").join(parity, "node"), "chained")
    total = save(members.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.lit(0).alias("shingles")), "chains")
    side = _dealt(members, total).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = side.select("family", F.least("block", "mate").alias("bi"), F.greatest("block", "mate").alias("bj"), "node", "block", "size", "bits")
    chained = side.groupBy("family", "bi", "bj").applyInArrow(_sieved(num, den), "u long, v long")
    near = save(pairs.unionByName(chained), "near")
    drop(family, members, total)
    return near


def text_digest(text):
    return F.xxhash64(F.lit(7), text)


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links, label, digest.

    A document's set holds its distinct ``width``-word shingles over lower-cased
    (A-Z) words; with fewer words the whole sequence is its one shingle; without
    words, or with a null text, the set is empty and links with nothing.  Two
    documents link when den * |A and B| >= num * |A or B|.  ``component_id`` is
    the smallest doc_id reachable by links, the document's own included; null
    doc_ids take part in links but are no component id unless all are null.
    ``n_links`` counts the other documents that link directly.  Repeated rows
    count as documents of their own.  An empty table gives no rows.  Other
    columns are not read.

    ``label`` names the component whatever its ids are (null for an empty set);
    ``digest`` is :func:`text_digest` of the row's text.

    Shingles and sets are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    plan = Plan(num, den)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), text)
    read = save(base.mapInArrow(tidied(_read(width)), "doc_id long, digest long, size long, node long, frequent boolean, bits binary"), "sets")
    sets = read.where("not frequent").select("doc_id", "digest", "size", "node", "bits")
    # the classes, aggregated before their shuffle: a class of many copies is one row from each task
    each = sets.where("size > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "digest")).alias("row"), F.min("doc_id").alias("low"), F.max("size").alias("size"), F.first("bits").alias("bits"))
    each = save(each, "each")
    counts = read.where("frequent").groupBy("node").agg(F.sum("size").alias("n")).where(F.col("n") >= FREQUENT)
    told = counts.orderBy(F.desc("n"), "node").limit(MAX_FREQUENT).select("node").toPandas()["node"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(told.astype(np.int64).view(U)))

    listed = base.select("text").mapInArrow(tidied(_lists(plan, width, frequent)), "key long, u long, v long")
    # every list lies in one sorted partition, where it is read through: one shuffle, which spills, whatever the number of keys
    dealt = listed.withColumn("key", F.coalesce("key", "v")).repartition("key").sortWithinPartitions("key", "u")
    tied = save(dealt.mapInArrow(tidied(lambda batches: _tied(batches, PAIRED)), "u long, v long"), "ties")
    parity = each.select("node", "size", "bits")
    near = _near(tied, parity, num, den)
    drop(tied)
    family = save(components(near), "families")
    drop(near)

    # one row of each class brings its text to verification
    pick = each.join(family.withColumnRenamed("label", "family"), "node")
    pick = save(pick.select("node", "family", "copies", "row", "size"), "members")
    drop(family)
    total = save(pick.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles")), "totals")
    side = bounded(_dealt(pick, total).select("row.doc_id", "row.digest", "node", "copies", "family", "block", "blocks"))
    cond = base["doc_id"].eqNullSafe(side["doc_id"]) & (base["digest"] == side["digest"])
    texts = base.join(side, cond).select("node", "copies", "family", "block", "blocks", "text")

    def tokens(batches):
        for b in batches:
            for at, n, data, off in tn.chunks(b.column(5)):
                tok, size = tn.shingles(*tn.words(data, off), width)
                stop = np.cumsum(size)
                part = [tok[z - s : z].tobytes() for z, s in zip(stop, size, strict=True)]
                yield pa.record_batch([*(b.column(i).slice(at, n) for i in range(5)), pa.array(part, pa.binary())], ["node", "copies", "family", "block", "blocks", "tokens"])

    sent = texts.mapInArrow(tidied(tokens), "node long, copies long, family long, block int, blocks int, tokens binary")
    within = save(sent.groupBy("family", "block").applyInArrow(_within(num, den), _FOUND + ", family long, block int, blocks int, sets binary"), "within")
    pairs = within.where("sets is not null").withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("mate != block")
    pairs = pairs.select("family", F.least("block", "mate").alias("bi"), F.greatest("block", "mate").alias("bj"), "sets")
    between = pairs.groupBy("family", "bi", "bj").applyInArrow(_between(num, den), _FOUND)
    found = save(within.where("node is not null").select("node", "label", "links").unionByName(between), "links")
    drop(pick, total, within)

    linked = components(found.select(F.col("node").alias("u"), F.col("label").alias("v")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = each.select("node", "low", "copies")
    classes = classes.join(linked, "node", "left").join(degree, "node", "left")
    classes = classes.select("node", "low", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = save(classes, "classes")  # heads and minima are written, so that a large component's rows can be split
    drop(found)
    least = save(classes.groupBy("label").agg(F.min("low").alias("component")), "least")
    named = classes.join(least, "label").select("node", "label", "component", "n_links")
    out = sets.select("doc_id", "digest", F.col("size").alias("n_shingles"), "node").join(named, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "label", "digest")
