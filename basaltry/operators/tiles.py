"""Matrices in square tiles, and their products.

A Tiles is a table of (bi, bj, at, v): tile (bi, bj) holds the entries of rows bi * side on and columns bj * side on; `at`
are their places in it (row * side + column, ascending), or null for a tile that is stored whole.  Tiles without entries are absent.

A product is cut into a grid of pi x pj x pk cells.  A tile of A goes to the pj cells of its rows and inner columns, a tile of B
to the pi cells of its inner rows and columns (of these to such alone as hold tiles of the other side), and each of pk cells makes a part
of a tile of C.  What moves are tiles, never scalar products; the grid is the one that moves the fewest bytes of those whose cells fit into a task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .matrix import as_lists, block
from .sparse import CSR

SIDE = 1024
#: Bytes of tiles and results that a cell of a product holds; scalar products that are held at a time.
CELL, PRODUCTS = 96 << 20, 1 << 21
#: Columns up to which the right side of a product is taken as dense panels.
NARROW = SIDE
#: Entries that a tile should hold.
FEW = 1 << 12
#: A tile with at least this share of its places is stored whole.
FULL = 0.5

_SCHEMA = "bi long, bj long, at array<int>, v array<double>"
_ARROW = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Tiles:
    """frame (bi, bj, at, v), the side of its tiles, and the matrix's height and width."""

    frame: DataFrame
    height: int
    width: int
    side: int = SIDE

    @property
    def T(self) -> Tiles:  # noqa: N802
        side = self.side

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for bi, bj, at, v in _tiles(b):
                    if at is None:
                        out.append((bj, bi, None, np.ascontiguousarray(v.reshape(side, side).T).ravel()))
                    else:
                        turned = at % side * side + at // side
                        order = np.argsort(turned)
                        out.append((bj, bi, turned[order], v[order]))
                yield _batch(out)

        return Tiles(self.frame.mapInArrow(run, _SCHEMA), self.width, self.height, side)

    def coords(self) -> DataFrame:
        side = self.side

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bi, bj, at, v in _tiles(b):
                    keep = np.flatnonzero(v)
                    place = keep if at is None else at[keep].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bi * side + place // side), pa.array(bj * side + place % side), pa.array(v[keep])], names=["i", "j", "v"])

        return self.frame.mapInArrow(run, "i long, j long, v double")

    def rows(self) -> DataFrame:
        """RowDF; a task holds side rows at a time.  Rows of tiles that are absent are absent."""
        side, height, width = self.side, self.height, self.width

        def panel(key: tuple, t: pa.Table) -> pa.Table:
            bi = key[0].as_py()
            n = min(side, height - bi * side)
            out = np.zeros((n, width))
            for _, bj, at, v in _tiles(t):
                part = _whole(at, v, side)[:n, : width - bj * side]
                out[:, bj * side : bj * side + part.shape[1]] += part
            return pa.table({"row_id": pa.array(bi * side + np.arange(n)), "features": as_lists(out)})

        if width > side:
            return self.frame.groupBy("bi").applyInArrow(panel, "row_id long, features array<double>")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bi, _, at, v in _tiles(b):
                    n = min(side, height - bi * side)
                    yield pa.RecordBatch.from_arrays([pa.array(bi * side + np.arange(n)), as_lists(_whole(at, v, side)[:n, :width])], names=["row_id", "features"])

        return self.frame.mapInArrow(run, "row_id long, features array<double>")


def _tiles(b: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray]]:
    at, v = (b[c].combine_chunks() if isinstance(b[c], pa.ChunkedArray) else b[c] for c in ("at", "v"))
    for k, (bi, bj) in enumerate(zip(b["bi"].to_pylist(), b["bj"].to_pylist(), strict=True)):
        a = at[k]
        yield bi, bj, a.values.to_numpy() if a.is_valid else None, v[k].values.to_numpy()


def _batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _whole(at: np.ndarray | None, v: np.ndarray, side: int) -> np.ndarray:
    if at is None:
        return v.reshape(side, side)
    out = np.zeros(side * side)
    out[at] = v
    return out.reshape(side, side)


def _stored(at: np.ndarray, v: np.ndarray, side: int) -> tuple[np.ndarray | None, np.ndarray]:
    if len(at) < FULL * side * side:
        return at.astype(np.int32), v
    return None, _whole(at, v, side).ravel()


def _narrow(x: np.ndarray, side: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The first columns of a tile, as it is stored."""
    w = x.shape[1]
    if w >= FULL * side:
        return None, np.pad(x, ((0, 0), (0, side - w))).ravel()
    return (np.arange(side)[:, None] * side + np.arange(w)).ravel().astype(np.int32), np.ascontiguousarray(x).ravel()


def from_coords(coords: DataFrame, height: int, width: int, side: int = SIDE) -> Tiles:
    """Tiles of a CoordDF; entries move once, to their tiles, and those that repeat add up there."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        (at,), (v,) = _added([t["at"].to_numpy()], [t["v"].to_numpy()])
        at, v = at[v != 0], v[v != 0]
        return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), *_stored(at, v, side))] if len(at) else [])])

    place = F.col("i") % side * side + F.col("j") % side
    cells = coords.where("v <> 0").select(F.floor(F.col("i") / side).alias("bi"), F.floor(F.col("j") / side).alias("bj"), place.cast("int").alias("at"), F.col("v").cast("double").alias("v"))
    return Tiles(cells.groupBy("bi", "bj").applyInArrow(pack, _SCHEMA), height, width, side)


def from_rows(rows: DataFrame, height: int, width: int, side: int = SIDE) -> Tiles:
    """Tiles of a dense RowDF; a task holds side rows at a time.  Tiles of a narrow matrix hold its columns alone."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        x, at = block(t["features"].combine_chunks()), t["row_id"].to_numpy() % side
        out = []
        for bj in range(-(-width // side)):
            tile = np.zeros((side, side))
            part = x[:, bj * side : (bj + 1) * side]
            tile[at, : part.shape[1]] = part
            stored = (None, tile.ravel()) if width > NARROW else _narrow(tile[:, : part.shape[1]], side)  # dense panels multiply whole
            out.append((key[0].as_py(), bj, *stored))
        return pa.Table.from_batches([_batch(out)])

    return Tiles(rows.select("row_id", "features").groupBy(F.floor(F.col("row_id") / side).alias("bi")).applyInArrow(pack, _SCHEMA), height, width, side)


@dataclass(frozen=True)
class Load:
    """Bytes of A, B and C, and what is known of tiles: parts are bytes of all parts of C where nothing is added up, bi and bj the places of A's tiles."""

    a: float
    b: float
    c: float
    parts: float = math.inf
    panel: float = 0.0
    bi: np.ndarray | None = None
    bj: np.ndarray | None = None

    def met(self, pi: int, pk: int) -> int:
        """Different (bi mod pi, bj mod pk) that A has tiles for."""
        return pi * pk if self.bi is None else len(np.unique(self.bi % pi * pk + self.bj % pk))

    def spread(self, pi: int) -> float:
        """Cells that a tile of B goes to."""
        return pi if self.bi is None else self.met(pi, int(self.bj.max()) + 1) / len(np.unique(self.bj))

    def made(self, pk: int, blocks: int) -> float:
        """Bytes of parts of C that are added up later."""
        return min(self.c * pk, self.parts, self.panel * self.met(blocks, pk) or math.inf)


def _fits(shape: tuple[int, int, int], load: Load, cell: int, blocks: int) -> bool:
    pi, pj, pk = shape
    cells = load.met(pi, pk)
    return load.a / cells + load.b * load.spread(pi) / (pj * cells) + min(load.c / (pi * pj), load.made(pk, blocks) / (pj * cells)) <= cell


def grid(a: float, b: float, c: float, blocks: tuple[int, int, int], tasks: int, cell: int | None = None, load: Load | None = None) -> tuple[int, int, int]:
    """The grid (pi, pj, pk) that moves the fewest bytes; a, b, c: bytes of the matrices, blocks: tiles along rows, columns and inside."""
    best, cell, load = None, cell or CELL, load or Load(a, b, c)
    sizes = [[min(n, 1 << e) for e in range(max(1, math.ceil(math.log2(max(1, n))) + 1))] for n in blocks]
    want = min(tasks, math.prod(blocks))
    spread, made, cells = ({x: fn(*x) for x in keys} for fn, keys in ((load.spread, [(p,) for p in sizes[0]]), (lambda k: load.made(k, blocks[0]), [(p,) for p in sizes[2]]), (load.met, list(itertools.product(sizes[0], sizes[2])))))
    for pi, pj, pk in itertools.product(*sizes):
        many, parts, copies = cells[pi, pk] * pj, made[pk,], spread[pi,]
        held = a / cells[pi, pk] + b * copies / many + min(c / (pi * pj), parts / many)
        moved = a * pj + b * copies + (parts if pk > 1 else 0)
        short = max(1.0, want / many)
        rank = (held > cell, moved * short if held <= cell else held, pi * pj * pk)
        if best is None or rank < best[0]:
            best = rank, (pi, pj, pk)
    return best[1]


def _times_narrow(left: pa.Table, right: pa.Table, side: int, width: int) -> list[tuple]:
    """_multiply for a right side of few columns: its rows of tiles are dense panels."""
    panels: dict[int, np.ndarray] = {}
    for bk, bj, at, v in _tiles(right):
        tile = panels.setdefault(bk, np.zeros((side, width)))
        part = _whole(at, v, side)[:, : width - bj * side]
        tile[:, bj * side : bj * side + part.shape[1]] += part
    out: dict[int, np.ndarray] = {}
    for bi, bk, at, v in _tiles(left):
        if bk in panels:
            x = _whole(at, v, side) if at is None else CSR(np.searchsorted(at // side, np.arange(side + 1)), (at % side).astype(np.int64), v, side)
            made = x @ panels[bk]
            out[bi] = out[bi] + made if bi in out else made
    return [(bi, bj, *_narrow(x[:, bj * side : (bj + 1) * side], side)) for bi, x in out.items() for bj in range(-(-width // side))]


def _multiply(left: pa.Table, right: pa.Table, side: int) -> list[tuple]:
    """Tiles (or their parts) of the product of the tiles in a cell."""
    inner: dict[int, tuple[list, list]] = {}
    for bk, bj, at, v in _tiles(right):
        inner.setdefault(bk, ([], []))[at is not None].append((bj, at, v))
    panels = {}
    for bk, (whole, sparse) in inner.items():
        if sparse:  # the sparse tiles of a row of tiles are one sparse panel
            rows = np.concatenate([at // side for _, at, _ in sparse])
            columns = np.concatenate([bj * side + (at % side).astype(np.int64) for bj, at, _ in sparse])
            order = np.argsort(rows, kind="stable")
            starts = np.searchsorted(rows[order], np.arange(side + 1))
            sparse = starts, columns[order], np.concatenate([v for *_, v in sparse])[order]
        panels[bk] = whole, sparse
    by_row: dict[int, list] = {}
    for tile in _tiles(left):
        if tile[1] in panels:
            by_row.setdefault(tile[0], []).append(tile)
    out = []
    for bi, tiles in by_row.items():
        dense: dict[int, np.ndarray] = {}
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, bk, at, v in tiles:
            whole, sparse = panels[bk]
            if whole:
                x = _whole(at, v, side) if at is None else CSR(np.searchsorted(at // side, np.arange(side + 1)), (at % side).astype(np.int64), v, side)
                for bj, _, w in whole:
                    made = x @ w.reshape(side, side)
                    dense[bj] = dense[bj] + made if bj in dense else made
            if sparse:
                starts, columns, values = sparse
                if at is None:
                    at, v = np.flatnonzero(v), v[np.flatnonzero(v)]
                i, k = at // side, at % side
                many = starts[k + 1] - starts[k]
                ends = np.cumsum(many)
                cut = 0
                while cut < len(at):
                    to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PRODUCTS, side="right")))
                    n = many[cut:to]
                    place = np.repeat(starts[k[cut:to]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    keys.append(np.repeat(i[cut:to].astype(np.int64), n) + columns[place] * side)  # ordered by column, then by row
                    sums.append(np.repeat(v[cut:to], n) * values[place])
                    cut = to
                if sum(map(len, keys)) > 4 * PRODUCTS:
                    keys, sums = _added(keys, sums)
        keys, sums = _added(keys, sums)
        keys, sums = keys[0], sums[0]
        tile_of = keys // (side * side)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(tile_of) != 0, [True]])) if len(keys) else np.zeros(1, int)
        for s, e in itertools.pairwise(edges):
            bj, local = int(tile_of[s]), keys[s:e] % (side * side)
            at, v = local % side * side + local // side, sums[s:e]
            if bj in dense:
                dense[bj].ravel()[at] += v
            else:
                order = np.argsort(at)
                out.append((bi, bj, *_stored(at[order], v[order], side)))
        for bj, made in dense.items():
            out.append((bi, bj, None, made.ravel()))
    return out


def _added(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    k, place = np.unique(np.concatenate(keys), return_inverse=True)
    return [k], [np.bincount(place, weights=np.concatenate(sums), minlength=len(k))]


#: Tiles whose places the driver takes to choose a grid; where there are more, cells are taken to have some each.
PLACES = 1 << 20


def multiply(a: Tiles, b: Tiles, shape: tuple[int, int, int] | None = None, alpha: float = 1.0, plus: Tiles | None = None) -> Tiles:
    """alpha A B, and plus; shape names the grid of cells that is used where its cells fit into a task, instead of the one chosen."""
    side = a.side
    if b.side != side or a.width != b.height:
        raise ValueError("tiles and inner dimensions must agree")
    size = lambda t: t.frame.agg(F.sum(F.size("v")), F.sum(8 * F.size("v") + 4 * F.greatest(F.size("at"), F.lit(0))), F.count("*")).first()
    (na, bytes_a, many), (nb, bytes_b, _) = ([x or 0 for x in size(t)] for t in (a, b))
    blocks = tuple(max(1, -(-n // side)) for n in (a.height, b.width, a.width))
    narrow, products = b.width * side <= NARROW * SIDE, 24 * na * nb / max(1, a.width)
    c, places = min(8.0 * a.height * b.width, products), {}
    if 0 < many <= min(PLACES, blocks[0] * blocks[2] // 2):  # tiles are absent
        found = a.frame.select("bi", "bj").toArrow()
        places = {x: found[x].to_numpy() for x in ("bi", "bj")}
    load = Load(bytes_a, bytes_b, c, math.inf if narrow else products, 8.0 * side * b.width if narrow else 0.0, **places)
    if shape is None or not _fits(shape, load, CELL, blocks[0]):
        shape = grid(bytes_a, bytes_b, c, blocks, int(a.frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), None, load)
    pi, pj, pk = shape
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.frame.withColumn("ci", F.pmod("bi", F.lit(pi)).cast("int")).withColumn("ck", F.pmod("bj", F.lit(pk)).cast("int")).withColumn("cj", copies(pj))
    right = b.frame.withColumn("cj", F.pmod("bj", F.lit(pj)).cast("int")).withColumn("ck", F.pmod("bi", F.lit(pk)).cast("int"))
    if places and pi > 1:  # B's tiles go where A has tiles for them
        where = a.frame.select(F.pmod("bi", F.lit(pi)).cast("int").alias("ci"), F.col("bj").alias("bk")).distinct()
        right = right.join(F.broadcast(where), F.col("bi") == F.col("bk")).drop("bk")
    else:
        right = right.withColumn("ci", copies(pi))
    by, width = ["ci", "cj", "ck"], b.width
    right = right.toDF(*[f"{c}_" for c in right.columns])  # A may be B, whose columns Spark must tell apart

    def cell(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.Table.from_batches([], schema=_ARROW)
        y = y.rename_columns([c[:-1] for c in y.column_names])
        return pa.Table.from_batches([_batch(_times_narrow(x, y, side, width) if narrow else _multiply(x, y, side))])

    made = left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_" for c in by])).applyInArrow(cell, _SCHEMA)
    if alpha != 1.0:
        made = made.withColumn("v", F.transform("v", lambda x: x * alpha))
    if plus is not None:
        made = made.unionByName(plus.frame)
    return Tiles(_summed(made, side) if pk > 1 or plus is not None else made, a.height, b.width, side)


def _summed(frame: DataFrame, side: int) -> DataFrame:
    """Tiles of the same place added up."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        parts = [(at, v) for *_, at, v in _tiles(t)]
        if len(parts) == 1:
            return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), *parts[0])])])
        if any(at is None for at, _ in parts):
            total = np.zeros(side * side)
            for at, v in parts:
                if at is None:
                    total += v
                else:
                    total[at] += v
            stored = None, total
        else:
            (at,), (v,) = _added([at for at, _ in parts], [v for _, v in parts])
            stored = _stored(at, v, side)
        return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), *stored)])])

    return frame.groupBy("bi", "bj").applyInArrow(add, _SCHEMA)


def add(a: Tiles, b: Tiles, alpha: float = 1.0, beta: float = 1.0) -> Tiles:
    """alpha A + beta B."""
    scaled = lambda t, f: t.frame.withColumn("v", F.transform("v", lambda x: x * f))
    return Tiles(_summed(scaled(a, alpha).unionByName(scaled(b, beta)), a.side), a.height, a.width, a.side)


def side_for(counts: list[tuple[int, int, int]]) -> int:
    """A side for tiles of matrices (entries, height, width): SIDE, doubled while the thinnest matrix has under FEW entries a tile and so
    more tiles than they are worth; places in a tile stay 32 bits."""
    share = min(((n / (h * w)) for n, h, w in counts if n and h and w), default=1.0)
    side = SIDE
    while side < 1 << 15 and share * side * side < FEW:
        side *= 2
    return side


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, trans_a: bool = False, trans_b: bool = False, side: int | None = None, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """alpha op(A) op(B) + beta C of CoordDFs by tiles; the result equals that of matrix.gemm.  side: side_for what they hold, unless named."""
    turn = lambda m: m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    a, b = turn(a) if trans_a else a, turn(b) if trans_b else b
    (na, m, k), (nb, k2, n) = ((c, *(0 if x is None else x + 1 for x in ends)) for c, *ends in (t.agg(F.count("*"), F.max("i"), F.max("j")).first() for t in (a, b)))
    inner = max(k, k2)
    side = side or side_for([(na, m, inner), (nb, inner, n)])
    x = Tiles(written(from_coords(a, m, inner, side).frame, "tiles"), m, inner, side)
    y = Tiles(written(from_coords(b, inner, n, side).frame, "tiles"), inner, n, side)
    plus = from_coords(c.select("i", "j", (beta * F.col("v")).alias("v")), m, n, side) if c is not None and beta else None  # added tile by tile
    return multiply(x, y, shape, alpha, plus).coords()
