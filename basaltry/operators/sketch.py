"""Sketching transforms: random maps from N to S dimensions.

`apply(rows, "rowwise")` compresses the features of each row (A to A W'); `"columnwise"` compresses the
number of rows (A to W A), with the row's id as its place among N.  A transform is a small JSON document:
its entries are made again from the seed wherever they are needed.

Hash sketches stay in Catalyst (a projection and a grouped sum).  Dense maps, mixing and feature
maps work on Arrow blocks of rows; a columnwise dense sketch makes the needed columns of W where the
rows are and adds up S x d partial sums.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.rng import Context
from .matrix import features, from_numpy, is_sparse, map_rows, parts_of, reduce_blocks, to_coords, to_rows, width_of
from .sparse import CSR

REGISTRY: dict[str, type[Sketch]] = {}
VERSION = "1"


def register(cls):
    REGISTRY[cls.__name__] = cls
    return cls


@dataclass(frozen=True)
class Sketch:
    """N: dimension that is compressed; S: its new size; seed and counter: where its samples begin; stream: the random
    numbers' kind, 'threefry' or 'portable'."""

    N: int
    S: int
    seed: int = 0
    counter: int = 0
    stream: str = field(default="threefry", kw_only=True)

    def to_json(self) -> str:
        return json.dumps({"object_type": "sketch", "sketch_type": type(self).__name__, "version": VERSION, **self.__dict__})

    @property
    def context(self) -> Context:
        return rng.STREAMS[self.stream](self.seed, self.counter)

    def matrix(self, columns: np.ndarray | None = None) -> np.ndarray:
        """W, S x N, or only some of its columns."""
        raise NotImplementedError(f"{type(self).__name__} is not a matrix")

    def map_block(self, x: np.ndarray | CSR) -> np.ndarray:
        """Rows of x (n x N) to n x S."""
        return project(self, x, _whole, self.matrix)

    def apply(self, rows: DataFrame, dimension: str = "columnwise") -> DataFrame:
        if dimension == "rowwise":
            if (d := width_of(rows)) != self.N:
                raise ValueError(f"rows have {d} features; the transform takes {self.N}")
            return map_rows(rows, self.map_block)
        if dimension == "columnwise":
            return self._columnwise(rows)
        raise ValueError("dimension is 'rowwise' or 'columnwise'")

    def _columnwise(self, rows: DataFrame) -> DataFrame:
        d = width_of(rows)
        if is_sparse(rows) and self.S * d > SQUARE:
            raise ValueError(f"a dense {self.S} x {d} result: columnwise_coords() gives its entries")
        total = reduce_blocks(rows.select("row_id", *parts_of(rows)), lambda b: _from_left(self.matrix(b["row_id"].to_numpy()), features(b)), (self.S, d))
        return from_numpy(rows.sparkSession, total)

    def columnwise_coords(self, rows: DataFrame) -> DataFrame:
        """The columnwise sketch of sparse rows as a CoordDF, however wide they are: each task adds up the columns that its rows have entries in,
        over as many of its batches as give SOME numbers."""

        def added(made: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            used, at = np.unique(np.concatenate([u for u, _ in made]), return_inverse=True)
            return used, np.stack([np.bincount(at, np.concatenate([v[k] for _, v in made]), len(used)) for k in range(self.S)])

        def coords(used: np.ndarray, v: np.ndarray):
            for at in range(0, len(used), step := max(1, SOME // 8 // self.S)):
                u, part = used[at : at + step], v[:, at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(self.S), len(u))), pa.array(np.tile(u, self.S)), pa.array(part.ravel())], names=["i", "j", "v"])

        def run(batches):
            made, held = [], 0
            for b in batches:
                for first, x in features(b).parts(max(1, SQUARE // self.S // 8)):
                    used, x = x.columns()
                    made.append((used, _from_left(self.matrix(b["row_id"].to_numpy()[first : first + len(x)]), x)))
                    held += self.S * len(used)
                    if held > SOME:
                        made = [added(made)]
                        held = self.S * len(made[0][0])
                        if 2 * held > SOME:  # too many different columns to be kept
                            yield from coords(*made[0])
                            made, held = [], 0
            if made:
                yield from coords(*added(made))

        return rows.select("row_id", *parts_of(rows)).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))

    def __mul__(self, rows: DataFrame) -> DataFrame:
        return self.apply(rows, "columnwise")

    def __truediv__(self, other):
        return NotImplemented

    def __rtruediv__(self, rows: DataFrame) -> DataFrame:
        return self.apply(rows, "rowwise")


#: Numbers of a random matrix that a worker makes whole and keeps; of larger ones only the columns that a sparse block has entries in, so many
#: numbers at a time.
SQUARE, SOME = 1 << 25, 1 << 22


def _from_left(w: np.ndarray, x: np.ndarray | CSR) -> np.ndarray:
    return (x.T @ w.T).T if isinstance(x, CSR) else w @ x


def project(t: Sketch, x: np.ndarray | CSR, whole, some) -> np.ndarray:
    """x W' for a transform's random matrix W: whole(t), or some(columns) for a sparse block of a wide matrix."""
    if not isinstance(x, CSR) or t.N * t.S <= SQUARE:
        return x @ whole(t).T
    used, x = x.columns()
    out, step = np.zeros((len(x), t.S)), max(1, SOME // t.S)
    order = np.argsort(x.at, kind="stable")
    rows, at, v = x.rows[order], x.at[order], x.v[order]
    for k in range(0, len(used), step):
        a, b = np.searchsorted(at, [k, k + step])
        # entries of these columns, in the order of their rows
        again = np.argsort(rows[a:b], kind="stable")
        starts = np.searchsorted(rows[a:b][again], np.arange(len(x) + 1))
        out += CSR(starts, (at[a:b] - k)[again], v[a:b][again], step) @ some(used[k : k + step]).T
    return out


@functools.lru_cache(maxsize=8)
def _whole(t: Sketch) -> np.ndarray:
    """W of a transform, made once in each process."""
    return t.matrix()


def from_json(text: str) -> Sketch:
    d = json.loads(text)
    cls = REGISTRY[d.pop("sketch_type")]
    return cls(**{k: v for k, v in d.items() if k not in ("object_type", "version")})


def create(kind: str, N: int, S: int, **params) -> Sketch:
    return REGISTRY[ALIASES.get(kind, kind)](N, S, **params)


# -- dense -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dense(Sketch):
    """Entry (i, j) is sample j * S + i of a distribution, times a scale."""

    def _entries(self, dist: str, columns: np.ndarray | None) -> np.ndarray:
        cols = np.arange(self.N) if columns is None else np.asarray(columns)
        return self.context.sample(dist, self.counter, cols[None, :] * self.S + np.arange(self.S)[:, None])


@register
@dataclass(frozen=True)
class JLT(Dense):
    """Gaussian entries over sqrt(S)."""

    def matrix(self, columns=None):
        return self._entries("normal", columns) / math.sqrt(self.S)


@register
@dataclass(frozen=True)
class CT(Dense):
    """Cauchy entries times C / S, for the 1-norm."""

    C: float = 1.0

    def matrix(self, columns=None):
        return self._entries("cauchy", columns) * self.C / self.S


@register
@dataclass(frozen=True)
class SJLT(Dense):
    """Sparse signs: a share `density` of entries, each plus or minus 1 / sqrt(density S)."""

    density: float = 1 / 3

    def matrix(self, columns=None):
        cols = np.arange(self.N) if columns is None else np.asarray(columns)
        u = self.context.uniform(self.counter, cols[None, :] * self.S + np.arange(self.S)[:, None])
        return np.where(u < self.density / 2, -1.0, np.where(u < self.density, 1.0, 0.0)) / math.sqrt(self.density * self.S)


# -- hashing -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Hashing(Sketch):
    """Each of N places goes to one of S buckets with a random value; in Catalyst from end to end."""

    def bucket(self, index: Column) -> Column:
        return rng.bucket(f"{self.seed}h{self.counter}", index, self.S)

    def value(self, index: Column) -> Column:
        raise NotImplementedError

    def coords(self, coords: DataFrame, dimension: str = "columnwise") -> DataFrame:
        """CoordDF to CoordDF: a grouped sum over the hashed index; partial sums come before the shuffle."""
        k, other = ("i", "j") if dimension == "columnwise" else ("j", "i")
        moved = coords.select(self.bucket(F.col(k)).alias(k), F.col(other), (self.value(F.col(k)) * F.col("v")).alias("v"))
        return moved.groupBy("i", "j").agg(F.sum("v").alias("v"))

    def columnwise_coords(self, rows: DataFrame) -> DataFrame:
        return self.coords(to_coords(rows, True))

    def table(self, spark: SparkSession) -> DataFrame:
        """(n, bucket, value) for every place."""
        return spark.range(self.N).select(F.col("id").alias("n"), self.bucket(F.col("id")).alias("bucket"), self.value(F.col("id")).alias("value"))

    def matrix(self, columns=None):
        spark = SparkSession.active()
        got = self.table(spark).collect()
        w = np.zeros((self.S, self.N))
        for n, b, v in got:
            w[b, n] = v
        return w if columns is None else w[:, columns]

    def apply(self, rows: DataFrame, dimension: str = "columnwise") -> DataFrame:
        if dimension == "columnwise":
            return to_rows(self.coords(to_coords(rows, True), dimension), width_of(rows))
        if dimension != "rowwise":
            raise ValueError("dimension is 'rowwise' or 'columnwise'")
        if (d := width_of(rows)) != self.N:
            raise ValueError(f"rows have {d} features; the transform takes {self.N}")
        got = self.table(rows.sparkSession).orderBy("n").toArrow()  # two numbers for each feature of a row
        shared = rows.sparkSession.sparkContext.broadcast((got["bucket"].to_numpy(), got["value"].to_numpy()))

        def add(x: np.ndarray | CSR) -> np.ndarray:
            out = np.zeros((self.S, len(x)))
            if isinstance(x, CSR):
                np.add.at(out, (shared.value[0][x.at], x.rows), x.v * shared.value[1][x.at])
                return out.T
            np.add.at(out, shared.value[0], (x * shared.value[1]).T)
            return out.T

        return map_rows(rows, add)


@register
@dataclass(frozen=True)
class CWT(Hashing):
    """Count sketch: signs."""

    def value(self, index):
        return rng.sign(f"{self.seed}v{self.counter}", index)


@register
@dataclass(frozen=True)
class MMT(Hashing):
    """Cauchy values, for the 1-norm."""

    def value(self, index):
        return rng.cauchy(f"{self.seed}v{self.counter}", index)


@register
@dataclass(frozen=True)
class WZT(Hashing):
    """Signed (1 / exponential)^(1/p), for the p-norm, 1 <= p <= 2."""

    p: float = 1.0

    def __post_init__(self):
        if not 1 <= self.p <= 2:
            raise ValueError("p lies between 1 and 2")

    def value(self, index):
        return rng.sign(f"{self.seed}v{self.counter}", index) * F.pow(1.0 / rng.exponential(f"{self.seed}e{self.counter}", index), F.lit(1.0 / self.p))


# -- fast unitary transforms -----------------------------------------------------------------------


def dct(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Orthonormal DCT-II along the last axis, by one FFT; inverse: DCT-III."""
    n = x.shape[-1]
    scale = np.full(n, math.sqrt(2.0 / n))
    scale[0] = math.sqrt(1.0 / n)
    phase = np.exp(-0.5j * math.pi * np.arange(n) / n)
    if not inverse:
        order = np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2)[::-1]])
        return np.real(np.fft.fft(x[..., order], axis=-1) * phase) * scale
    y = x / scale  # the unscaled transform; its spectrum has y[k] - i y[n - k] after the phase
    mirrored = np.concatenate([np.zeros_like(y[..., :1]), y[..., :0:-1]], axis=-1)
    spectrum = (y - 1j * mirrored) * np.conj(phase)
    back = np.real(np.fft.ifft(spectrum, axis=-1))
    v = np.empty_like(back)
    v[..., 0::2] = back[..., : (n + 1) // 2]
    v[..., 1::2] = back[..., (n + 1) // 2 :][..., ::-1]
    return v


def wht(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform along the last axis, padded to a power of two."""
    n = 1 << max(0, (x.shape[-1] - 1).bit_length())
    y = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, n - x.shape[-1])]).astype(np.float64)
    h = 1
    while h < n:
        y = y.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        y = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2)
        h *= 2
    return y.reshape(*x.shape[:-1], n) / math.sqrt(n)


def dht(x: np.ndarray) -> np.ndarray:
    """Orthonormal discrete Hartley transform along the last axis."""
    f = np.fft.fft(x, axis=-1)
    return (f.real - f.imag) / math.sqrt(x.shape[-1])


@register
@dataclass(frozen=True)
class RFUT(Sketch):
    """Mixing: a fast unitary transform after random signs; S equals N."""

    transform: str = "dct"

    def signs(self) -> np.ndarray:
        return self.context.sample("rademacher", self.counter, np.arange(self.N))

    def map_block(self, x):
        if isinstance(x, CSR):
            return x.by_parts(self.map_block)
        y = x * self.signs()
        return dct(y) if self.transform == "dct" else dht(y)

    def inverse_block(self, x):
        return (dct(x, inverse=True) if self.transform == "dct" else dht(x)) * self.signs()

    def apply_inverse(self, rows: DataFrame) -> DataFrame:
        return map_rows(rows, self.inverse_block)

    def matrix(self, columns=None):
        w = self.map_block(np.eye(self.N)).T
        return w if columns is None else w[:, columns]

    def _columnwise(self, rows):
        return _by_columns(rows, self.map_block)


def _by_columns(rows: DataFrame, fn) -> DataFrame:
    """fn on each column of the matrix (as a row); a column must fit into a task's memory."""
    d = width_of(rows)
    cells = to_coords(rows, True)

    def one(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t["i"].to_numpy(), kind="stable")
        out = fn(t["v"].to_numpy()[order][None, :])[0]
        return pa.table({"i": pa.array(np.arange(len(out))), "j": pa.array(np.full(len(out), key[0].as_py())), "v": pa.array(out)})

    return to_rows(cells.groupBy("j").applyInArrow(one, "i long, j long, v double"), d)


@register
@dataclass(frozen=True)
class FJLT(Sketch):
    """sqrt(N / S) times S coordinates, drawn with replacement, of a mixed vector."""

    def _mixer(self) -> RFUT:
        return RFUT(self.N, self.N, self.seed, self.counter, stream=self.stream)

    def samples(self) -> np.ndarray:
        return self.context.integers(self.N, self.counter + self.N, np.arange(self.S))

    def map_block(self, x):
        if isinstance(x, CSR):  # entries in closed form cost less than a mixed row
            return project(self, x, _whole, self.matrix)
        return self._mixer().map_block(x)[:, self.samples()] * math.sqrt(self.N / self.S)

    def matrix(self, columns=None):
        """Entries in closed form, so that a columnwise sketch needs no whole column in one place."""
        n = np.arange(self.N) if columns is None else np.asarray(columns)
        k = self.samples()[:, None]
        scale = np.where(k == 0, math.sqrt(1.0 / self.N), math.sqrt(2.0 / self.N)) * math.sqrt(self.N / self.S)
        signs = self.context.sample("rademacher", self.counter, n)
        return scale * np.cos(math.pi * (2 * n[None, :] + 1) * k / (2 * self.N)) * signs


# -- sampling -----------------------------------------------------------------------------------------


@register
@dataclass(frozen=True)
class UST(Sketch):
    """Uniform sampling of S of N places, with or without replacement.

    Without replacement the sample are the places with the smallest portable words, in their order; of rows they are found as a distributed top-S.
    """

    replace: bool = True

    def samples(self) -> np.ndarray:
        if self.replace:
            return self.context.integers(self.N, self.counter, np.arange(self.S))
        return np.argsort(rng.Portable(self.seed).words(0, np.arange(self.N)), kind="stable")[: self.S]

    def map_block(self, x):
        if isinstance(x, CSR):
            return x.by_parts(self.map_block)
        return x[:, self.samples()]

    def matrix(self, columns=None):
        w = np.zeros((self.S, self.N))
        w[np.arange(self.S), self.samples()] = 1.0
        return w if columns is None else w[:, columns]

    def drawn(self, rows: DataFrame) -> DataFrame:
        """(k, row_id) of the S draws."""
        if not self.replace:
            word = rng.word(self.seed, F.col("row_id"))
            top = rows.select("row_id", word.alias("w")).orderBy("w", "row_id").limit(self.S)
            return top.select((F.row_number().over(Window.orderBy("w", "row_id")) - 1).cast("long").alias("k"), "row_id")
        return rows.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.samples())], "k long, row_id long")

    def _columnwise(self, rows):
        drawn = self.drawn(rows)
        drawn = F.broadcast(drawn) if self.S <= 1_000_000 else drawn
        return rows.join(drawn, "row_id").select(F.col("k").alias("row_id"), *parts_of(rows))


@register
@dataclass(frozen=True)
class URST(UST):
    """Sampling without replacement."""

    replace: bool = False


@register
@dataclass(frozen=True)
class NURST(UST):
    """Sampling with given probabilities (any positive scale), with replacement.  They stand in the JSON form; for
    probabilities that are a column of many rows see weighted_sample."""

    probabilities: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "probabilities", tuple(self.probabilities))

    def samples(self) -> np.ndarray:
        edges = np.cumsum(self.probabilities) / np.sum(self.probabilities)
        return np.minimum(np.searchsorted(edges, self.context.uniform(self.counter, np.arange(self.S)), side="right"), self.N - 1)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those with the smallest hashed keys (a distributed top-n)."""
    return df.orderBy(rng.word(seed, F.col(key)), key).limit(n)


#: Rows of a block of weighted_sample.
BLOCK = 1 << 20


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement, a row's chance proportional to its weight: (draw, key).

    Running sums of weights become intervals; draws are matched by a range join.  Sums run within hash
    blocks of keys first, about BLOCK rows each however many there are, so no task orders many rows.
    """
    some = df.where(F.col(weight) > 0)
    blocks = max(256, -(-some.count() // BLOCK))
    rows = some.select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w"), (rng.word(f"{seed}b", F.col(key)) % blocks).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("w").alias("total")).select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"), F.sum("total").over(Window.partitionBy()).alias("all"))
    upto = F.sum("w").over(Window.partitionBy("block").orderBy("key"))
    spans = rows.withColumn("upto", upto).join(F.broadcast(sums), "block").select("key", ((F.col("before") + F.col("upto") - F.col("w")) / F.col("all")).alias("low"), ((F.col("before") + F.col("upto")) / F.col("all")).alias("high"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), rng.uniform(f"{seed}d", F.col("id")).alias("u"))
    cells = max(16, min(4096, n))  # equal cells of (0, 1] turn the range join into an equi-join
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    draws = draws.withColumn("cell", F.floor(F.col("u") * cells))
    return draws.join(spans, "cell").where("u > low and u <= high").select("draw", "key")


# -- feature maps -----------------------------------------------------------------------------------


@register
@dataclass(frozen=True)
class PPT(Sketch):
    """TensorSketch of the kernel (gamma x.y + c)^q: the product of q count sketches' spectra."""

    q: int = 2
    gamma: float = 1.0
    c: float = 1.0

    def map_block(self, x):
        ctx, base, out = self.context, self.counter, None
        for k in range(self.q):
            at = base + k * (2 * self.N + 2)
            h = ctx.integers(self.S, at, np.arange(self.N + 1))
            s = ctx.sample("rademacher", at + self.N + 1, np.arange(self.N + 1))
            y = np.zeros((len(x), self.S))
            if isinstance(x, CSR):
                np.add.at(y, (x.rows, h[x.at]), x.v * s[x.at] * math.sqrt(self.gamma))
            else:
                np.add.at(y.T, h[: self.N], (x * s[: self.N] * math.sqrt(self.gamma)).T)
            y[:, h[self.N]] += math.sqrt(self.c) * s[self.N]
            f = np.fft.rfft(y, axis=1)
            out = f if out is None else out * f
        return np.fft.irfft(out, n=self.S, axis=1)


@dataclass(frozen=True)
class Features(Sketch):
    """z = scale f(W x + shift) for a random W; only rowwise."""

    def frequencies(self, columns: np.ndarray | None = None) -> np.ndarray:
        """W, S x N, or only some of its columns."""
        raise NotImplementedError

    def shifts(self) -> np.ndarray:
        return self.context.uniform(self.counter + 4 * self.N * self.S, np.arange(self.S)) * 2 * math.pi

    def map_block(self, x):
        return math.sqrt(2.0 / self.S) * np.cos(project(self, x, _frequencies, self.frequencies) + _shifts(self))

    def _columnwise(self, rows):
        raise ValueError("feature maps work on rows: dimension 'rowwise'")

    def _draw(self, dist: str, columns: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(self.N) if columns is None else np.asarray(columns)
        return self.context.sample(dist, self.counter, at[None, :] * self.S + np.arange(self.S)[:, None])


@functools.lru_cache(maxsize=64)
def _frequencies(t: Features) -> np.ndarray:
    """Frequencies of a feature map, made once in each process."""
    return t.frequencies()


@functools.lru_cache(maxsize=64)
def _shifts(t: Features) -> np.ndarray:
    return t.shifts()


def _degrees(nu: float) -> int:
    """Degrees of freedom of a Matern map's scales."""
    if nu <= 0 or 2 * nu != round(2 * nu):
        raise ValueError("2 nu is a positive whole number")
    return round(2 * nu)


@register
@dataclass(frozen=True)
class GaussianRFT(Features):
    sigma: float = 1.0

    def frequencies(self, columns=None):
        return self._draw("normal", columns) / self.sigma


@register
@dataclass(frozen=True)
class LaplacianRFT(Features):
    sigma: float = 1.0

    def frequencies(self, columns=None):
        return self._draw("cauchy", columns) / self.sigma


@register
@dataclass(frozen=True)
class MaternRFT(Features):
    nu: float = 1.0
    l: float = 1.0  # noqa: E741

    def frequencies(self, columns=None):
        chi = self.context.chi_square(_degrees(self.nu), self.counter + 2 * self.N * self.S, np.arange(self.S))
        return self._draw("normal", columns) / self.l * np.sqrt(2 * self.nu / chi)[:, None]


@dataclass(frozen=True)
class QuasiFeatures(Features):
    """Frequencies and shifts by quantiles of a leaped Halton sequence of N + 1 dimensions."""

    skip: int = 0

    @functools.cached_property
    def _points(self) -> np.ndarray:
        return np.clip(rng.halton(np.arange(self.skip, self.skip + self.S), self.N + 1), 1e-12, 1 - 1e-12)

    def shifts(self):
        return 2 * math.pi * self._points[:, self.N]

    def _draw(self, dist, columns=None):
        return rng.quantile(dist, self._points[:, : self.N] if columns is None else self._points[:, columns])


@register
@dataclass(frozen=True)
class GaussianQRFT(QuasiFeatures):
    sigma: float = 1.0
    frequencies = GaussianRFT.frequencies


@register
@dataclass(frozen=True)
class LaplacianQRFT(QuasiFeatures):
    sigma: float = 1.0
    frequencies = LaplacianRFT.frequencies


@register
@dataclass(frozen=True)
class ExpSemigroupRLT(Features):
    """Random Laplace features exp(-W x) / sqrt(S) with Levy frequencies, for non-negative x."""

    beta: float = 1.0

    def frequencies(self, columns=None):
        return self._draw("levy", columns) * self.beta**2 / 2

    def map_block(self, x):
        return np.exp(-project(self, x, _frequencies, self.frequencies)) / math.sqrt(self.S)


@register
@dataclass(frozen=True)
class ExpSemigroupQRLT(QuasiFeatures):
    beta: float = 1.0
    frequencies, map_block = ExpSemigroupRLT.frequencies, ExpSemigroupRLT.map_block


@register
@dataclass(frozen=True)
class FastGaussianRFT(Features):
    """Fastfood: blocks of scale H G P H B x, with a cosine transform for H."""

    sigma: float = 1.0

    def _row_scale(self, blocks: int) -> np.ndarray:
        return np.full((blocks, self.N), 1.0 / (self.sigma * math.sqrt(self.N)))

    def frequencies(self, columns=None):
        """For each block its signs, scales of the middle, permutation and scales of the outputs."""
        blocks, ctx, n = -(-self.S // self.N), self.context, self.N
        scale, out = self._row_scale(blocks), []
        for k in range(blocks):
            at = self.counter + k * 4 * n
            p = rng.STREAMS[self.stream](self.seed, at + 2 * n).permutation(n)
            out.append((ctx.sample("rademacher", at, np.arange(n)), ctx.sample("normal", at + n, np.arange(n)), p, n * scale[k]))
        return out

    def map_block(self, x):
        if isinstance(x, CSR):
            return x.by_parts(self.map_block)
        blocks, shifts = _frequencies(self), _shifts(self)
        w = np.concatenate([dct(dct(x * b)[:, p] * g) * scale for b, g, p, scale in blocks], axis=1)[:, : self.S]
        return math.sqrt(2.0 / self.S) * np.cos(w + shifts)


@register
@dataclass(frozen=True)
class FastMaternRFT(FastGaussianRFT):
    nu: float = 1.0
    l: float = 1.0  # noqa: E741

    def _row_scale(self, blocks):
        chi = self.context.chi_square(_degrees(self.nu), self.counter + 5 * blocks * self.N, np.arange(blocks * self.N)).reshape(blocks, self.N)
        return np.sqrt(2 * self.nu / chi) / (self.l * math.sqrt(self.N))


ALIASES = {"SparseJLT": "SJLT", "FastJLT": "FJLT", "CountSketch": "CWT", "RRT": "GaussianRFT", "Fastfood": "FastGaussianRFT", "MaternFastfood": "FastMaternRFT", "TensorSketch": "PPT", "UniformSampler": "UST", "NonUniformSampler": "NURST"}


__all__ = ["ALIASES", "REGISTRY", "Sketch", "create", "from_json", *REGISTRY]
