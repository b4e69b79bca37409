"""What the operators of this folder share: the shared work folder, written tables, small Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import drop as drop_written
from ..sources.tables import fresh_path, written

__all__ = ["bounded", "drop_written", "fresh_names", "fresh_path", "id_hash_mod", "in_parts", "join_named", "keeps", "only", "record_batch", "released", "runs_of", "small", "utf8", "written"]

def id_hash_mod(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def utf8(x) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes; the column may be string or binary."""
    return x.cast(pa.binary()).to_pylist() if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x.to_pylist()


#: Bytes of a batch of texts between the JVM and Python.
BATCH, SPARKS_OWN = 4 << 20, "67108864b"


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on the session's Arrow batches hold BATCH bytes at most (or one row), unless the session names its own bound.
    By rows alone a batch has 10,000, whatever their length."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) == SPARKS_OWN:
        conf.set(name, str(BATCH))
    return df


def in_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_KEPT: dict[str, Callable[[], object]] = {}
_LAST = [""]


def keeps(name: str, forget: Callable[[], object]) -> None:
    """A worker process keeps something between tasks of operator name; forget drops it."""
    _KEPT[name] = forget


def only(name: str) -> None:
    """A task of operator name begins: what other operators keep in this process goes, and freed memory back to the system."""
    if _LAST[0] == name:
        return
    _LAST[0] = name
    for other, forget in _KEPT.items():
        if other != name:
            forget()
    released()


def released() -> None:
    """Freed memory of this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores in front until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: Rows that a join of these operators broadcasts at most (some MB).
NAMES = 1 << 16


def small(df: DataFrame) -> DataFrame:
    """df (written, or cheap to make), to be broadcast if it has NAMES rows or fewer."""
    return F.broadcast(df) if df.count() <= NAMES else df


def join_named(rows: DataFrame, named: DataFrame, on: list[str], copies: str, most: int = NAMES) -> DataFrame:
    """rows joined with named (written; one row for each key on, nulls are keys too; copies: rows that have the key).

    Up to most of named are broadcast.  Of more those whose key has more than a most-th of all rows, so fewer than most, and
    only the others meet their rows in a shuffle: no key crowds a task.
    """
    keys = fresh_names(rows, *[f"key_{c}" for c in on])
    right = named.withColumnsRenamed(dict(zip(on, keys, strict=True)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(on, keys, strict=True)])
    n, total = named.agg(F.count("*"), F.sum(copies)).first()
    if n <= most:
        return rows.join(F.broadcast(right), same).drop(*keys)
    hot = F.col(copies) > max(1 << 12, (total or 0) // most)
    rest = rows.join(F.broadcast(right.where(hot).select(keys)), same, "left_anti")
    return rows.join(F.broadcast(right.where(hot)), same).unionByName(rest.join(right.where(~hot), same)).drop(*keys)


def runs_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that agree in the columns by, as they stand."""
    kept: pa.Table | None = None
    for b in batches:
        now = pa.Table.from_batches([b])
        now = now if kept is None else pa.concat_tables([kept, now]).combine_chunks()
        if not now.num_rows:
            continue
        keys = np.stack([now[c].to_numpy() for c in by])
        edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1]).tolist()
        for start, end in zip(edges, edges[1:], strict=False):
            yield now.slice(start, end - start)
        kept = now.slice(edges[-1])  # the last run may go on in the next batch
    if kept is not None:
        yield kept
