"""Near-dedup of embeddings by cosine, with a subspace pigeonhole join.

For unit vectors a cosine of at least t means a squared distance of at most 2(1-t).
Vectors are turned by a fixed rotation and split into blocks of about ``WIDTH``
dimensions; if a pair is that close, its squared distance in at least one block is at
most that block's proportional share of the budget. So in every block a range join
with that radius finds candidates, and the union over blocks misses none.

The range join of a block: pivots taken from a bounded sample part the block's space
into cells; a vector is at home in the cell of its nearest pivot and visits every cell of
a higher number whose border with its own is within the radius. Two vectors within the
radius thus meet in exactly one cell, at home of one of them at least. Pivots only steer
the work, any choice gives the same result. Cells are dealt into tiles, so a crowded one
is spread over many tasks.

What travels to the cells is a vector's slice of the block. There a tile finds whose slice
is close to whose, and names the vectors that have a partner, not the pairs. Only these
come back with the whole vector, to the same tiles, where pairs are verified by exact
cosine in double precision and counted once, in the first block in which they are close.
Tiles give counts and spanning forests.

Exact copies are one row with a multiplicity while joining. Vectors link only within
one label and one dimension. Vectors that are null, zero, or hold null or non-finite
components, and those with a null label or id, link with nothing: n_links is 0 and they
are their own component and kept. Ids keep their type, and components that of doubles or
floats. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, over_tiles, spanning, tiled
from corpusloom.session import stored

COSINE = 0.98
WIDTH = 16
#: Vectors of the largest label for each pivot, and the most pivots (the sample they come from is no larger).
PER_PIVOT = 4096
MOST_PIVOTS = 2048
TILE = 4096
#: Allowances for rounding: of distances in single precision, and of radii.
SLACK = 1e-5
#: Rows that are compared with a tile at once, and pairs verified at once.
ROWS = 256
PAIRS = 1 << 16


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def turned(unit: np.ndarray) -> np.ndarray:
    """Rotated rows; summed one dimension at a time, so a row's result does not depend on its neighbours."""
    q = rotation(unit.shape[1])
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * q[k]
    return out


def cuts(dim: int, width: int = WIDTH) -> list[int]:
    blocks = max(1, round(dim / width))
    return [dim * k // blocks for k in range(blocks + 1)]


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])  # exact, and squares stay finite
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _radius(cosine: float, lo: int, hi: int, dim: int) -> float:
    return float(np.sqrt(2 * (1 - cosine) * (hi - lo) / dim))


def _dealt(distinct: DataFrame, cosine: float) -> DataFrame:
    """Rows (key, home, vid, part) for each cell of a vector's home and visits, with its slice of the block."""
    largest = distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    wanted = int(min(MOST_PIVOTS, max(1, largest // PER_PIVOT)))
    sample = distinct.orderBy(F.xxhash64(F.lit("pivot"), "h1"), "vid").limit(wanted).select("dim", "embedding").collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in sample}:
        pivots[dim] = turned(_unit(np.array([r["embedding"] for r in sample if r["dim"] == dim], np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                got = turned(_unit(np.stack(some["embedding"].to_numpy()).astype(np.float64)))
                own = pivots.get(dim, np.zeros((1, dim)))
                edges, label, vid = cuts(dim), some["label"].astype(str).to_numpy(), some["vid"].to_numpy()
                for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    x, p = got[:, lo:hi], own[:, lo:hi]
                    far = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                    home = far.argmin(axis=1)
                    apart = np.sqrt(np.maximum(0, (p * p).sum(1)[home][:, None] - 2 * (p @ p.T)[home] + (p * p).sum(1)[None, :]))
                    goes = far - far[np.arange(len(x)), home][:, None] <= 2 * (_radius(cosine, lo, hi, dim) + SLACK) * apart + SLACK
                    row, cell = np.nonzero(goes & (np.arange(len(p))[None, :] >= home[:, None]))
                    slices = x.astype(np.float32)
                    yield pd.DataFrame({"key": [f"{label[r]}:{dim}:{b}:{c}" for r, c in zip(row.tolist(), cell.tolist(), strict=True)], "home": home[row] == cell, "block": b, "vid": vid[row], "part": list(slices[row])})

    return distinct.select("vid", F.col("label").cast("string").alias("label"), "dim", "embedding").mapInPandas(run, "key string, home boolean, block int, vid long, part array<float>")


def _close(part: np.ndarray, home: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows, of which i is at home and j is a visitor or after i, at a squared distance of ``limit`` or less."""
    order = np.concatenate((np.flatnonzero(home), np.flatnonzero(~home)))
    x = part[order]
    square = (x * x).sum(1, dtype=np.float32)
    one = np.ones_like(square)
    left = np.column_stack((-2 * x, square, one)).astype(np.float32)
    right = np.ascontiguousarray(np.column_stack((x, one, square)).astype(np.float32).T)
    homes = int(home.sum())
    for a in range(0, homes, ROWS):
        end = min(a + ROWS, homes)
        i, j = np.nonzero(left[a:end] @ right[:, a:] <= limit)
        later = j > i
        yield order[i[later] + a], order[j[later] + a]


def _slices(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(part["part"].to_numpy()).astype(np.float32), part["home"].to_numpy()


def _apart(part: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs belong to this tile: those of two chunks, or any where there is one."""
    if part["lo"].iloc[0] == part["hi"].iloc[0]:
        return np.ones(len(i), bool)
    side = part["chunk"].to_numpy()
    return side[i] != side[j]


def _involved(limits: dict[tuple[int, int], float]):
    """Per tile the rows that have a partner within the block's radius."""

    def work(part: pd.DataFrame) -> pd.DataFrame | None:
        x, home = _slices(part)
        some = np.zeros(len(part), bool)
        for i, j in _close(x, home, limits[int(part["dim"].iloc[0]), int(part["block"].iloc[0])]):
            mine = _apart(part, i, j)
            some[i[mine]] = some[j[mine]] = True
        return part.loc[some, ["key", "lo", "hi", "chunk", "home", "block", "vid", "part"]] if some.any() else None

    return work


def _verified(cosine: float):
    """Per tile the numbers of links of its vectors (b is -1) and a spanning forest (n is -1)."""
    budget = 2 * (1 - cosine)

    def work(part: pd.DataFrame) -> pd.DataFrame | None:
        x, home = _slices(part)
        ids, n = part["vid"].to_numpy(), part["n"].to_numpy()
        unit = _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64))
        got, dim, block, size = turned(unit), unit.shape[1], int(part["block"].iloc[0]), len(ids)
        edges = cuts(dim)
        shares = np.array([budget * (b - a) / dim * (1 + 1e-9) for a, b in zip(edges, edges[1:], strict=False)])
        count, linked = np.zeros(size, np.int64), np.zeros((size, size), bool)
        for i, j in _close(x, home, _limit(cosine, edges[block], edges[block + 1], dim)):
            mine = _apart(part, i, j)
            i, j = i[mine], j[mine]
            for k in range(0, len(i), PAIRS):
                u, v = i[k : k + PAIRS], j[k : k + PAIRS]
                close = (unit[u] * unit[v]).sum(axis=1) >= cosine
                u, v = u[close], v[close]
                first = (np.add.reduceat((got[u] - got[v]) ** 2, edges[:-1], axis=1) <= shares).argmax(axis=1) == block
                u, v = u[first], v[first]
                count += (np.bincount(u, n[v], size) + np.bincount(v, n[u], size)).astype(np.int64)
                linked[u, v] = linked[v, u] = True
        some = np.flatnonzero(count)
        if not len(some):
            return None
        tree = spanning(size, linked.__getitem__)
        return pd.DataFrame({"a": np.concatenate([ids[some], ids[[u for u, _ in tree]]]), "b": np.concatenate([np.full(len(some), -1), ids[[v for _, v in tree]]]), "n": np.concatenate([count[some], np.full(len(tree), -1)])})

    return work


def _limit(cosine: float, lo: int, hi: int, dim: int) -> float:
    return _radius(cosine, lo, hi, dim) ** 2 + SLACK


def links(distinct: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, n) of _verified over written rows (vid, n, h1, label, dim, embedding)."""
    cells = stored(_dealt(distinct, cosine), "cells")
    dims = [r["dim"] for r in distinct.select("dim").distinct().collect()]  # a number per dimension that occurs
    limits = {(d, b): _limit(cosine, lo, hi, d) for d in dims for b, (lo, hi) in enumerate(zip(cuts(d), cuts(d)[1:], strict=False))}
    rows, tasks = tiled(cells.withColumn("dim", F.split("key", ":")[F.size(F.split("key", ":")) - 3].cast("int")), "key", "vid", TILE)
    kind = "key string, lo int, hi int, chunk int, home boolean, block int, vid long, part array<float>"
    involved = stored(over_tiles((rows, tasks), "key", _involved(limits), kind), "involved")
    whole = involved.join(distinct.select("vid", "n", "embedding"), "vid")
    return over_tiles((whole, tasks), "key", _verified(cosine), "a long, b long, n long")


def near_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    vector = F.transform(F.col(embedding).cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind))  # no negative zeros
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), vector.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    tag = lambda salt: F.when(sound, F.xxhash64(F.lit(salt), "label", "embedding"))
    rows = rows.withColumns({"h1": tag("a"), "h2": tag("b")})
    distinct = rows.where("h1 is not null").groupBy("h1", "h2", "label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    # numbers of a written table do not change
    distinct = stored(distinct.withColumns({"dim": F.size("embedding"), "vid": F.monotonically_increasing_id()}), "vectors")
    found = stored(links(distinct, cosine), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("vid")).agg(F.sum("n").alias("links"))
    joined = components(found.where("n < 0").select("a", "b")).select(F.col("id").alias("vid"), "component")
    named = distinct.select("h1", "h2", "vid", "id", "n").join(counts, "vid", "left").join(joined, "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
