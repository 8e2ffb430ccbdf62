"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Codes: unit vectors are centred and rotated by a rotation learned on a bounded
sample (``sample_rows``): of the sample's principal components, at most
``tables`` * ``key_bits``, alternately the signs are taken as codes and the
rotation is fitted to them (orthogonal Procrustes). The signs are the code.

Tables: the code is dealt into ``tables`` disjoint parts of at most ``key_bits``
bits. A pair at cosine >= least has a squared distance of at most e = 2 - 2 *
least, which neither centring nor rotation changes and dropped components only
lessen, so in some part it is at most e / tables. Where a bit of that part
differs, the two components lie on either side of zero, so the squares of both
vectors' components at those bits sum to at most e / tables, and those of one of
the two to at most half of that. Each vector therefore looks into the cells of
all keys that it reaches by turning bits whose squared components sum to at most
half of e / tables, and finds every partner that does not find it: retrieval is
exact for every pair, whatever the data. A vector with more than ``probes`` such
keys looks by the first 12, 8, 4 or no bits of the part, into the cells of that
level. Candidates are reranked with the original vectors in double precision.

Equal vectors of a label are one class; only classes enter the tables. Parts have
as many bits as leave about ``cell_rows`` classes of the largest label to a cell.
A task has all cells of a label, or of a label with more than ``block`` classes
those whose keys begin alike, so that a vector is sent once to each task and not
to each cell; what it needs beyond the vector it works out again. A task of more
than ``block`` rows is dealt in blocks, and blocks of looking and of lying
classes are compared as matrices, cell by cell, so a task never holds more than
two blocks, whatever a cell's size. A pair that meets several times is counted in
the first table, and there for the looking class with the lower number. Links
between classes are counted, not listed: for components each task gives every
linked class with one class of its component there.

Vectors that are null or zero or hold null or non-finite components, and rows
without a label, link with nothing. Vectors of different lengths are not
compared. Finite components of any size count, however small or large. Columns
beyond these three are not read, whatever their names. Rows without an id keep a null component; rows that share an id are
separate vectors of one name. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Workspace, components, few

SAMPLE_ROWS, ITERATIONS = 4000, 30
TABLES, KEY_BITS, PROBES = 4, 16, 64
#: Classes of the largest label to a cell, about, and of a block that is compared in one task.
CELL_ROWS, BLOCK = 256, 8192
#: Vector lengths for which a rotation is learned; others get a fixed one.
LENGTHS = 16
#: Bits between two levels of a table.
STEP = 4
#: Squared components are compared as integers, so that every task decides alike.
SCALE = 1 << 30


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Quantiser:
    """Mean, rotation and tables of code bits for vectors of one length."""

    def __init__(self, sample: np.ndarray, least: float, tables: int, key_bits: int, probes: int, iterations: int = ITERATIONS):
        """sample may have no rows: then the rotation is a fixed one."""
        n = sample.shape[1]
        rng = np.random.default_rng(7)
        x = unit(sample)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(n)
        x = x - self.mean
        bits = min(n, tables * key_bits)
        main = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
        x = x @ main
        rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        for _ in range(iterations):
            u, _, v = np.linalg.svd(np.where(x @ rotation >= 0, 1.0, -1.0).T @ x)
            rotation = (u @ v).T
        self.rotation = main @ rotation
        self.parts = np.array_split(rng.permutation(bits), max(1, min(tables, bits // STEP)))
        self.levels = [sorted({*range(0, len(p), STEP), len(p)}) for p in self.parts]
        self.probes = probes
        # rounding of the double arithmetic and of the stored components is far below the margin
        self.limit = int(((2 - 2 * least) / len(self.parts) / 2 * (1 + 1e-5) + 1e-7) * SCALE)

    def components(self, vectors: np.ndarray) -> np.ndarray:
        return ((unit(vectors) - self.mean) @ self.rotation).astype(np.float32)

    @staticmethod
    def squares(y: np.ndarray) -> np.ndarray:
        return np.floor(y.astype(np.float64) ** 2 * SCALE).astype(np.int64)

    def spots(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, parts) levels at which each row looks, and (row, spot) in row order: where it lies (even) and looks (odd)."""
        levels = np.zeros((len(y), len(self.parts)), np.int32)
        rows, spots = [], []
        for t, part in enumerate(self.parts):
            code, square = (y[:, part] >= 0).astype(np.int64), self.squares(y[:, part])
            home = np.zeros(len(y), np.int64)
            row, key, cost = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
            done, left = 0, None
            for level in self.levels[t]:
                for j in range(done, level):
                    home |= code[:, j] << j
                    key |= code[row, j] << j
                    turned = cost + square[row, j]
                    fits = np.flatnonzero(turned <= self.limit)
                    row, key, cost = np.concatenate([row, row[fits]]), np.concatenate([key, key[fits] ^ (1 << j)]), np.concatenate([cost, turned[fits]])
                done = level
                base = (t * 64 + level) << 33
                rows.append(np.arange(len(y)))
                spots.append(base | home << 1)
                few = np.bincount(row, minlength=len(y)) <= self.probes
                if left is not None:  # rows with too many keys here look by the level before
                    stay = ~few[left[0]]
                    rows.append(left[0][stay])
                    spots.append(left[1][stay])
                keep = few[row]
                row, key, cost = row[keep], key[keep], cost[keep]
                levels[row, t] = level
                left = row, base | key << 1 | 1
            rows.append(left[0])
            spots.append(left[1])
        row, spot = np.concatenate(rows), np.concatenate(spots)
        order = np.argsort(row, kind="stable")
        return levels, row[order], spot[order]

    def sees(self, t: int, y: np.ndarray, levels: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the vectors with components y, looking at the given levels, find the others in table t."""
        part = self.parts[t]
        differ = ((y[:, part] >= 0) != (other[:, part] >= 0)) & (np.arange(len(part)) < levels[:, t, None])
        return (self.squares(y[:, part]) * differ).sum(axis=1) <= self.limit


def usable(vector: str) -> F.Column:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0)


def rows_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Quantisers:
    """Quantisers by vector length: learned ones, and fixed ones for lengths that have none."""

    def __init__(self, learned: dict[int, Quantiser], make: Callable[[np.ndarray], Quantiser]):
        self.by, self.make = learned, make

    def __getitem__(self, dim: int) -> Quantiser:
        if dim not in self.by:
            if len(self.by) > 4 * LENGTHS:
                self.by.clear()
            self.by[dim] = self.make(np.zeros((0, dim)))
        return self.by[dim]


def fit(classes: DataFrame, make: Callable[[np.ndarray], Quantiser], sample_rows: int) -> Quantisers:
    """Learned quantisers for the LENGTHS most frequent vector lengths, each from about sample_rows classes with the least hashes.

    A share of the classes that holds about three times as many is kept where they are read, so that only those are ranked.
    """
    lengths = classes.groupBy("dim").agg(F.count("*").alias("__n")).orderBy(F.col("__n").desc(), "dim").limit(LENGTHS)
    h = F.xxhash64(F.lit("sample"), "class")
    rows = classes.join(F.broadcast(lengths), "dim").where(h / F.lit(2.0**64) + 0.5 < F.least(F.lit(1.0), 3 * sample_rows / F.col("__n")))
    order = Window.partitionBy("dim").orderBy(h, "class", "number")
    by: dict[int, list] = {}
    for r in rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows).select("dim", "v").toLocalIterator():
        by.setdefault(r.dim, []).append(r.v)
    return Quantisers({d: make(np.array(v, np.float64)) for d, v in by.items()}, make)


def tasks_of(spots: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The tasks in which spots are: cells whose keys begin with the same prefix bits are in one; without a prefix all of a label are."""
    place, key = spots >> 33, spots >> 1 & 0xFFFFFFFF
    bits = np.minimum(prefix, place & 63)
    return np.where(prefix == 0, 0, ((place >> 6) * 64 + bits + 1) << 32 | key & ((1 << bits) - 1))


#: Rows that are compared at once: the blocks of a label, length and task.
TILE = ["label", "dim", "task", "i", "j"]


def visited(classes: DataFrame, quantisers: Quantisers) -> DataFrame:
    """(number, label, dim, task, looks, lies) of each task in which a class has cells."""

    @arrow_udf("array<struct<task long, looks boolean, lies boolean>>")
    def visits(dims: pa.Array, prefixes: pa.Array, vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(dims)
        d, prefix = dims.to_numpy(zero_copy_only=False), prefixes.to_numpy(zero_copy_only=False)
        for dim in np.unique(d):
            where = np.flatnonzero(d == dim)
            q = quantisers[int(dim)]
            _, row, spot = q.spots(q.components(rows_of(vectors.take(pa.array(where)))))
            task, looks = tasks_of(spot, prefix[where][row]), spot & 1
            key, role = np.unique(np.stack([row, task], 1), axis=0, return_inverse=True)
            ask, answer = np.zeros(len(key), bool), np.zeros(len(key), bool)
            ask[role.ravel()[looks == 1]] = True
            answer[role.ravel()[looks == 0]] = True
            for r, t, x, y in zip(key[:, 0].tolist(), key[:, 1].tolist(), ask.tolist(), answer.tolist(), strict=True):
                if out[where[r]] is None:
                    out[where[r]] = []
                out[where[r]].append({"task": t, "looks": x, "lies": y})
        return pa.array(out, pa.list_(pa.struct([("task", pa.int64()), ("looks", pa.bool_()), ("lies", pa.bool_())])))

    return classes.select("number", "label", "dim", F.explode(visits("dim", "prefix", "v")).alias("at")).select("number", "label", "dim", "at.*")


def tiled(ws: Workspace, classes: DataFrame, quantisers: Quantisers, block: int) -> DataFrame:
    """Classes with the tiles in which they are compared: of each task the pairs of a block that looks and one that lies."""
    met = ws.save(visited(classes, quantisers), "visited")
    count = lambda c: F.sum(F.col(c).cast("int"))
    sizes = met.groupBy("label", "dim", "task").agg(count("looks").alias("p"), count("lies").alias("h"), F.min("number").alias("low"), F.max("number").alias("high"))
    sizes = sizes.where("p > 0 and h > 0 and low < high").withColumn("ps", F.ceil(F.col("p") / block).cast("int")).withColumn("hs", F.ceil(F.col("h") / block).cast("int")).drop("low", "high")
    mine = lambda n: F.pmod(F.xxhash64(F.lit("block"), "number"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    i, j = mine("ps"), mine("hs")
    asked = F.when(F.col("looks"), F.transform(every("hs"), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(True).alias("asks"), (F.col("lies") & (k == j)).alias("answers"))))
    lying = F.when(F.col("lies"), F.transform(F.filter(every("ps"), lambda k: ~(F.col("looks") & (k == i))), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))))
    none = F.array().cast("array<struct<i:int,j:int,asks:boolean,answers:boolean>>")
    rows = met.join(sizes, ["label", "dim", "task"]).withColumn("t", F.explode(F.concat(F.coalesce(asked, none), F.coalesce(lying, none))))
    # small tasks go many to one
    many = F.greatest(F.lit(1), F.lit(classes.count() // 1024)).cast("long")
    rows = rows.select("number", "task", "t.*", "label", "dim", (F.col("p") + F.col("h") > 1024).alias("large"))
    rows = rows.select("number", "task", "i", "j", "asks", "answers", F.when(F.col("large"), F.xxhash64(*TILE)).otherwise(F.pmod(F.xxhash64(*TILE), many)).alias("deal"))
    return rows.join(classes.select("number", "label", "dim", "prefix", "class", "n", "v"), "number")


def roots(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index reachable from each index by the links (x, y)."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(rows: DataFrame, quantisers: Quantisers, least: float) -> DataFrame:
    """(class, n_links, near): for each linked class of a task, the rows linked there and a class of its component."""

    def pairs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        q = quantisers[table.column("dim")[0].as_py()]
        number, at = np.unique(table.column("number").to_numpy(), return_inverse=True)
        first = np.zeros(len(number), np.int64)
        first[at] = np.arange(len(at))
        once = table.take(pa.array(first)).combine_chunks()  # a class of several tiles here is held once
        ids, n, prefix = (once.column(c).to_numpy() for c in ("class", "n", "prefix"))
        v = unit(rows_of(once.column("v").chunk(0)))
        y = q.components(v)
        levels, owner, spot = q.spots(y)
        task_of, begin = tasks_of(spot, prefix[owner]), np.searchsorted(owner, np.arange(len(ids) + 1))
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        task, i, j = (table.column(c).to_numpy() for c in ("task", "i", "j"))
        asks, answers = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "answers"))
        order = np.lexsort((j, i, task, label))
        changes = np.zeros(len(order) - 1, bool)
        for c in (label, task, i, j):
            changes |= np.diff(c[order]) != 0
        links, xs, ys = np.zeros(len(ids), np.int64), [], []
        for tile in np.split(order, np.flatnonzero(changes) + 1):
            # the spots of the tile's classes that lie in its task
            who = at[tile]
            size = begin[who + 1] - begin[who]
            where = np.arange(size.sum()) + np.repeat(begin[who] - np.cumsum(size) + size, size)
            here, row = spot[where], np.repeat(np.arange(len(tile)), size)
            takes = np.where(here & 1 == 1, asks[tile][row], answers[tile][row]) & (task_of[where] == task[tile[0]])
            here, row = here[takes], who[row[takes]]
            by = np.argsort(here, kind="stable")
            here, row = here[by], row[by]
            for cell in np.split(np.arange(len(here)), np.flatnonzero(np.diff(here >> 1)) + 1):
                looks = here[cell] & 1 == 1
                a, b = row[cell[looks]], row[cell[~looks]]
                if not len(a) or not len(b):
                    continue
                tab = int(here[cell[0]] >> 39)
                for start in range(0, len(a), 256):
                    part = a[start : start + 256]
                    x, z = np.nonzero(v[part] @ v[b].T >= least)
                    x, z = part[x], b[z]
                    x, z = x[x != z], z[x != z]
                    if not len(x):
                        continue
                    fresh = (x < z) | ~q.sees(tab, y[z], levels[z], y[x])
                    for t in range(tab):  # a pair that met in an earlier table was counted there
                        fresh &= ~(q.sees(t, y[x], levels[x], y[z]) | q.sees(t, y[z], levels[z], y[x]))
                    x, z = x[fresh], z[fresh]
                    np.add.at(links, x, n[z])
                    np.add.at(links, z, n[x])
                    xs.append(x)
                    ys.append(z)
        near = roots(len(ids), np.concatenate([*xs, np.zeros(0, np.int64)]), np.concatenate([*ys, np.zeros(0, np.int64)]))
        hit = links > 0
        return pa.table({"class": ids[hit], "n_links": links[hit], "near": ids[near[hit]]})

    return rows.groupBy("dim", "deal").applyInArrow(pairs, "class long, n_links long, near long")


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, tables: int = TABLES, key_bits: int = KEY_BITS, probes: int = PROBES, block: int = BLOCK, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of df."""
    ws = Workspace(df.sparkSession, "vectors")
    fits = F.coalesce(usable(vector), F.lit(False)) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fits, F.col(label)).alias("label"), F.when(fits, F.col(vector)).alias("v"))
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("class"), F.count("*").alias("n"))
    classes = ws.save(classes.withColumn("dim", F.size("v")).withColumn("number", F.monotonically_increasing_id()), "classes")
    sizes = ws.save(classes.groupBy("label", "dim").agg(F.count("*").alias("__rows")), "sizes")
    most = sizes.agg(F.max("__rows")).first()[0] or 1
    bits = min(key_bits, max(STEP, (most // cell_rows).bit_length()))
    quantisers = fit(classes, lambda sample: Quantiser(sample, least, tables, bits, probes), sample_rows)
    # a task has about block classes: with more, those whose keys begin alike
    prefix = F.greatest(F.lit(0), F.least(F.lit(bits), F.ceil(F.log2(F.col("__rows") / block)))).cast("int")
    placed = classes.join(few(sizes), ["label", "dim"]).withColumn("prefix", prefix).drop("__rows")
    linked = ws.save(compare(tiled(ws, placed, quantisers, block), quantisers, least), "linked")
    counts = linked.groupBy("class").agg(F.sum("n_links").alias("links"))
    labels = components(ws, linked.select(F.col("class").alias("a"), F.col("near").alias("b")), "labels").withColumnRenamed("id", "class")
    named = classes.join(counts, "class", "left").join(labels, "class", "left")
    named = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "class").alias("component"))
    out = rows.join(named, ["label", "v"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
