"""Cells and one-bit codes: the index under nearest-neighbour search and clustering.

Cells. A bounded sample (SAMPLE_ROWS, documented) is condensed into leaders, no
two of which are closer than LEADER_COS; leaders that stand for two or more sample
rows are cells of their own, the rest of the space is cut by coarse centroids. The
number of both follows the number of rows, as far as the sample goes. Every row is
indexed in its best cell and searches that cell, and more of them when its place is
uncertain. Rows travel once to each cell they belong to or search. A cell whose share
of the sample promises more than BLOCK_ROWS rows is cut into blocks, and all its
queries meet all its blocks, so no task grows with a hot cell.

Codes. Within a cell each row is the sign bits of its randomly rotated offset from
the cell's centre, with its offset length and the code's alignment as correction
scalars. Inner products are estimated from the bits with an error bound; rows whose
upper bound reaches a query's k-th best lower bound are reranked exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.session import wide

SAMPLE_ROWS, LEADER_COS = 65_536, 0.75
#: Rows for which there is one leader, or one coarse cell, and the least and most of each.
LEADER_EACH, COARSE_EACH, LEADERS, COARSES = 100, 2_000, (1_024, 16_384), (64, 1_024)
TIGHT_COS, MARGIN, PROBES, BLOCK_ROWS = 0.80, 0.06, 8, 16_384
#: A row outside the leaders searches its PROBES best coarse cells, but none this much worse than its home.
COARSE_MARGIN = 0.08
#: Half-width of the error bound in units of the estimator's spread.
EPSILON = 2.5
#: Routed rows for which there is one task, so that tasks keep their size as the rows grow.
TASK_ROWS = 16_384
#: A vector is hot when more rows than this, and more than a HOT_SHARE-th of all rows, are copies of
#: it: fewer than HOT_SHARE vectors can be. Of a hot vector only `kept` ids of each batch travel to the
#: cells; its other copies take their result from a broadcast of one row per hot vector.
HOT_ROWS, HOT_SHARE = 4_096, 2_000


def census(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of vectors(h, ...), and the hashes h of the hot vectors (fewer than HOT_SHARE)."""
    counts = vectors.groupBy("h").count()
    rows, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if most <= HOT_ROWS:
        return rows, []
    return rows, [r["h"] for r in counts.filter((F.col("count") > HOT_ROWS) & (F.col("count") > rows / HOT_SHARE)).select("h").collect()]


def usable(x: np.ndarray) -> np.ndarray:
    """True for the rows of finite numbers that aren't all zero; nulls arrive as NaN."""
    return np.isfinite(x).all(1) & (x != 0).any(1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-300)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Cells:
    """Centres of the leader cells, then of the coarse cells, each cell's estimated rows and its number of blocks."""

    centres: np.ndarray
    n_leaders: int
    size: np.ndarray
    blocks: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.blocks is None:
            self.cut(BLOCK_ROWS)

    def cut(self, rows: int) -> None:
        """Cut cells into blocks of about `rows` rows."""
        self.blocks = np.maximum(1, np.ceil(self.size / rows)).astype(np.int64)

    def route(self, x: np.ndarray, probes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of each unit row of x, and (row, cell) of the further cells that it searches.

        A row near a leader lives with it and searches leaders that are nearly as
        near; any other lives in its best coarse cell, and searches the next best and
        leaders in reach. Without probes no row searches a coarse cell but its home.
        """
        home, rows, cells = np.empty(len(x), np.int64), [], []
        n, centres = self.n_leaders, self.centres.T
        for lo in range(0, len(x), 1024):
            s = x[lo : lo + 1024] @ centres
            lead, coarse, m = s[:, :n], s[:, n:], np.arange(len(s))
            first = lead.argmax(1) if n else np.zeros(len(s), np.int64)
            top = lead[m, first] if n else np.full(len(s), -1.0)
            tight = top >= TIGHT_COS
            home[lo : lo + len(s)] = first
            if n:
                r, c = np.divmod(np.flatnonzero(lead >= np.where(tight, top - MARGIN, TIGHT_COS - MARGIN)[:, None]), n)
                other = ~tight[r] | (c != first[r])
                rows.append(r[other] + lo)
                cells.append(c[other])
            open_ = np.flatnonzero(top < (TIGHT_COS + MARGIN if probes else TIGHT_COS))
            far = min(PROBES if probes else 1, coarse.shape[1])
            some = coarse[open_]
            near = np.argpartition(-some, far - 1, axis=1)[:, :far]
            value = np.take_along_axis(some, near, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
            loose = ~tight[open_]
            home[lo + open_[loose]] = near[loose, 0] + n
            asks = value >= value[:, :1] - COARSE_MARGIN
            asks[loose, 0] = False
            asks[~loose, 2:] = False
            r, k = np.nonzero(asks)
            rows.append(open_[r] + lo)
            cells.append(near[r, k] + n)
        return home, np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *cells])


def fit_cells(sample: Callable[[float, int], DataFrame], rows: int, seed: int = 11, leaders: bool = True, dim: int = 64) -> Cells:
    """Cells for `rows` rows, from at most ~SAMPLE_ROWS of them: sample(share, seed) gives rows with vec, a BINARY of floats.

    Without leaders, coarse cells cut the whole space. An empty sample gives random ones of `dim` dimensions.
    """
    most, n_coarse = (int(min(max(rows // each, low), high)) for each, (low, high) in ((LEADER_EACH, LEADERS), (COARSE_EACH, COARSES)))
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    raw = sample(share, seed).select("vec").toArrow().column("vec").to_pylist()
    if not raw:
        return Cells(unit(np.random.default_rng(seed).standard_normal((n_coarse, dim))).astype(np.float32), 0, np.zeros(n_coarse))
    x = unit(np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)).astype(np.float32)
    x = x[np.lexsort(x.T[:4])]
    x = x[np.random.default_rng(seed).permutation(len(x))]
    tight, size, loose = np.zeros((0, x.shape[1]), np.float32), np.zeros(0), x
    if leaders:
        tight, size, loose = _leaders(x, most)
        if len(loose) < n_coarse:
            loose = np.vstack([loose, x[: n_coarse - len(loose)]])
    loose = loose[: 64 * n_coarse]
    centres = loose[:n_coarse].copy()
    for _ in range(3):
        to = (loose @ centres.T).argmax(1)
        sums = np.zeros(centres.shape)
        np.add.at(sums, to, loose)
        full = np.bincount(to, minlength=len(centres)) > 0
        centres[full] = unit(sums[full]).astype(np.float32)
    size = np.concatenate([size, np.bincount((loose @ centres.T).argmax(1), minlength=len(centres)) * (len(x) - size.sum()) / max(len(loose), 1)]) / share
    return Cells(np.vstack([tight, centres]), len(tight), size)


def _leaders(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and sizes of the `most` largest sets of sample rows around a leader, two rows or more each, and the other leaders."""
    leaders, count, total, n = np.empty_like(x), np.zeros(len(x), np.int64), np.zeros(x.shape), 0
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        at = np.full(len(part), -1)
        if n:
            s = part @ leaders[:n].T
            at = np.where(s.max(1) >= LEADER_COS, s.argmax(1), -1)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            near = part[rest] @ part[rest].T >= LEADER_COS
            free = np.ones(len(rest), bool)
            for i in range(len(rest)):
                if free[i]:
                    hit = near[i] & free
                    at[rest[hit]] = n
                    free &= ~hit
                    leaders[n] = part[rest[i]]
                    n += 1
        np.add.at(count, at, 1)
        np.add.at(total, at, part)
    leaders, count, total = leaders[:n], count[:n], total[:n]
    order = np.argsort(-count, kind="stable")
    kept = order[count[order] >= 2][:most]
    return unit(total[kept]).astype(np.float32), count[kept].astype(float), leaders[np.setdiff1d(order, kept)]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of floats in a binary column without nulls, all of one length, as a view of its buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float32, (offsets[-1] - offsets[0]) // 4, offsets[0]).reshape(len(column), -1)


def binaries(x: np.ndarray) -> pa.Array:
    """A binary column of the rows of x."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x)])


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def ids_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of lists of 16-byte ids, as bytes that sort like them, and how many each row has."""
    parts = [c for c in column.chunks if len(c)]
    flat = [matrix16(c.flatten()) for c in parts]
    sizes = [np.diff(c.offsets.to_numpy()) for c in parts]
    return np.concatenate([np.zeros(0, "V16"), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)


def matrix16(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "V16", len(column), offsets[0]) if len(column) else np.zeros(0, "V16")


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 16-byte ids in order, and each one's place among them."""
    halves = np.ascontiguousarray(ids).view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.r_[True, (halves[order][1:] != halves[order][:-1]).any(1)] if len(ids) else np.zeros(0, bool)
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    return ids[order[new]], place


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each group of the given sizes, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


ROUTED = "cell long, ib int, qb int, home boolean, asks boolean, parts int, vec binary, weight double, h long, ids array<binary>"


def route(vectors: DataFrame, cells: Cells, hot: list[int], probes: bool = True, kept: int = 1) -> DataFrame:
    """Rows (cell, ib, qb, home, asks, parts, vec, weight, h, ids) of vectors(iuid BINARY, vec BINARY, weight, h).

    Equal vectors of a batch travel once, with all their ids (the `kept` smallest
    of a hot vector). `home` rows are indexed in the cell, `asks` rows search it;
    parts is the number of cells and blocks that a query searches. Without probes
    no row searches other blocks than its own, so each row is home in one group only.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((cells.centres, cells.n_leaders, cells.size, cells.blocks))
    names = ["cell", "ib", "qb", "home", "asks", "parts", "vec", "weight", "h", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, marked = Cells(*shared.value), np.array(sorted(hot), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, h = matrix(batch.column("vec")), batch.column("h").to_numpy()
            names_, rank = ranked(matrix16(batch.column("iuid")))
            order = np.lexsort((rank, h))
            _, first, counts = np.unique(h[order], return_index=True, return_counts=True)
            if (x[order] != np.repeat(x[order[first]], counts, 0)).any():  # two vectors share a hash
                order = np.lexsort((rank, *x.T))
                first = np.flatnonzero(np.r_[True, (x[order][1:] != x[order][:-1]).any(1)])
                counts = np.diff(np.r_[first, len(x)])
            weight = np.add.reduceat(batch.column("weight").to_numpy()[order], first)
            x, h = x[order[first]], h[order[first]]
            stay = (within(counts) < kept) | ~np.isin(np.repeat(h, counts), marked)
            sizes = np.add.reduceat(stay.astype(np.int64), first)
            starts = np.cumsum(sizes) - sizes
            flat = names_[rank[order[stay]]]
            home, row, cell = cells.route(unit(x).astype(np.float32), probes)
            row, cell, own = np.r_[np.arange(len(x)), row], np.r_[home, cell], np.r_[np.ones(len(x), bool), np.zeros(len(row), bool)]
            blocks = cells.blocks[cell]
            parts = np.zeros(len(x), np.int64)
            np.add.at(parts, row, blocks)
            mine = h[row] % blocks
            if probes:
                # a row goes to all queries' blocks with its own as index block, and asks all index blocks from its own
                twice = np.where(own, 2 * blocks - 1, blocks)
                k = within(twice)
                row, cell, own, blocks, mine = (np.repeat(c, twice) for c in (row, cell, own, blocks, mine))
                asks = k < blocks
                ib = np.where(asks, k, mine)
                qb = np.where(asks, mine, (k - blocks) + (k - blocks >= mine))
                holds = own & (ib == mine)
            else:
                ib = qb = mine
                asks, holds = np.ones(len(row), bool), own
            n = sizes[row]
            ids = lists(np.r_[0, np.cumsum(n)], binaries(flat[np.repeat(starts[row], n) + within(n)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(ib.astype(np.int32)), pa.array(qb.astype(np.int32)), pa.array(holds), pa.array(asks), pa.array(parts[row].astype(np.int32)), binaries(x[row]), pa.array(weight[row]), pa.array(h[row]), ids],
                names=names,
            )

    return vectors.mapInArrow(run, ROUTED)


def per_cell(routed: DataFrame, rows: int, run: Callable, schema: str, together: int = 0) -> DataFrame:
    """Apply `run` to the table of each (cell, ib, qb); record batches out. `rows`, about as many as are routed, sets the tasks.

    Cells are many and mostly small, so a task walks its sorted cells in one
    pass and holds one cell at a time, or gives `run` a list of cells of
    `together` rows in all.
    """
    keys = ["cell", "ib", "qb"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        cells: list[pa.Table] = []
        at, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(k[:, lo].tolist())
                if at is not None and now != at:
                    cells.append(pa.Table.from_batches(kept))
                    kept = []
                    if not together:
                        yield from run(cells.pop())
                    elif held >= together:
                        yield from run(cells)
                        cells, held = [], 0
                at = now
                kept.append(batch.slice(lo, hi - lo))
                held += hi - lo
        if kept:
            cells.append(pa.Table.from_batches(kept))
            yield from run(cells) if together else run(cells[0])

    n = max(wide(routed.sparkSession), -(-rows // TASK_ROWS))
    return routed.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(walk, schema)


def distinct_vectors(t: pa.Table, cell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a table of one or more cells: its rows in the order of cell and vector, where each distinct vector begins, and how many rows it has."""
    h, x = t.column("h").to_numpy(), matrix(t.column("vec"))
    cell = np.zeros(len(h), np.int64) if cell is None else cell

    def cut(keys: tuple) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys)
        return order, np.flatnonzero(np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])

    order, first = cut((h, cell))
    counts = np.diff(np.r_[first, len(h)])
    if (x[order] != np.repeat(x[order[first]], counts, 0)).any():  # two vectors share a hash
        order, first = cut((*x.T, cell))
        counts = np.diff(np.r_[first, len(h)])
    return order, first, counts


#: A query's first exact products: the best row by estimate of each of this many stretches of rows, the GUESSES times k best of them.
STRETCHES, GUESSES = 64, 2


def _products(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    out = np.empty(len(qi), q.dtype)
    for lo in range(0, len(qi), 20_000):
        out[lo : lo + 20_000] = np.einsum("ij,ij->i", q[qi[lo : lo + 20_000]], x[xi[lo : lo + 20_000]])
    return out


def search(q: np.ndarray, x: np.ndarray, k: int, min_cos: float, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of each query's k best rows of x with at least min_cos, and of those equal to the k-th.

    Estimates come from one-bit codes of x. The exact products of a few rows that
    look best give a floor under the k-th best; every row whose error bound
    reaches the floor is reranked with its exact inner product.
    """
    n, dim = x.shape
    centre = x.mean(0)
    off = (x - centre) @ turn.T
    length = np.sqrt(np.einsum("ij,ij->i", off, off))
    bits = np.packbits(off >= 0, axis=1)
    align = np.where(length > 1e-9, np.abs(off).sum(1) / np.sqrt(dim) / np.maximum(length, 1e-9), 1.0)
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    width = (length * np.sqrt(np.maximum(1 - align**2, 0)) / align * epsilon / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    qoff = (q - centre) @ turn.T
    qlen = np.sqrt(np.einsum("ij,ij->i", qoff, qoff)).astype(np.float32)
    # estimate = offset . code x scale + query . centre - centre . centre + row . centre, as one product
    left = np.column_stack([qoff, np.ones(len(q)), q @ centre - centre @ centre]).astype(np.float32)
    right = np.column_stack([signs * (length / align)[:, None], x @ centre, np.ones(n)]).astype(np.float32).T
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    least, few = np.float32(min_cos - 1e-6), min(GUESSES * k, STRETCHES)
    per = -(-n // STRETCHES)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), step := max(16, 400_000 // n)):
        part, part32 = q[lo : lo + step], q32[lo : lo + step]
        m = len(part)
        est = left[lo : lo + step] @ right
        floor = np.full(m, least, np.float32)
        if n > 4 * few:
            whole = n // per * per
            at = est[:, :whole].reshape(m, -1, per).argmax(2) + np.arange(0, whole, per)
            top = np.take_along_axis(est, at, 1)
            best = np.take_along_axis(at, np.argpartition(-top, few - 1, axis=1)[:, :few], 1)
            exact = _products(part32, x32, np.repeat(np.arange(m), few), best.ravel()).reshape(m, few)
            floor = np.maximum(floor, np.partition(exact, few - k, axis=1)[:, few - k] - np.float32(1e-6))
        est += qlen[lo : lo + step, None] * width
        qi, xi = np.divmod(np.flatnonzero(est >= floor[:, None]), n)
        some = _products(part32, x32, qi, xi) >= floor[qi] - np.float32(1e-6)
        qi, xi = qi[some], xi[some]
        exact = _products(part, x, qi, xi)
        order = np.lexsort((-exact, qi))
        qi, xi, exact = qi[order], xi[order], exact[order]
        starts = np.searchsorted(qi, np.arange(m))
        last = np.minimum(starts + k, np.r_[starts[1:], len(qi)]) - 1
        kth = exact[np.maximum(last, 0)] if len(exact) else np.zeros(m)
        good = (exact >= min_cos - 1e-9) & (exact >= kth[qi] - 2e-9)
        found.append((qi[good] + lo, xi[good], exact[good]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
