"""Batched K-Means: every restart of every K shares each pass over the data.

The reference runs ``n_init`` restarts for each K (15 x 7 = 105 models in the K
search). Fitting them one after another reads the data once per model per
iteration; here one pass per iteration serves all models still moving:

* **Blocks**: the coordinates are packed once into blocks of up to ``BLOCK`` rows
  (NumPy arrays in a persisted RDD), so a pass sends a few large records to the
  tasks and plans no query.
* **Seeding** (k-means++, batched): one pass per center index; each task keeps,
  per model, its best candidate under weighted-reservoir keys
  ``log(u) / D^2`` (Efraimidis-Spirakis), and the largest key wins.
* **Lloyd step**: a block is assigned to the nearest center of every model with
  one matrix product per K, and another one adds up each cluster's rows; a task
  emits one (centers x (d + 1)) table, the only thing that reaches the driver.
* **Labels** of one or several models are added by ``label_rows`` in one pass;
  ``assign`` gives those of one as a JVM column expression.

A row's random number is a hash of its id, the seed, the model and the step, so
the same rows give the same fit in any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, rows that are measured at once (their distances stay in a core's cache) and rows of a task.
BLOCK, ROWS, TASK_ROWS = 4096, 512, 500_000


@dataclass
class KMeansFit:
    k: int
    restart: int
    centers: np.ndarray
    inertia: float
    iterations: int


def _blocks(df: DataFrame, cols: Sequence[str], id_col: str, tasks: int) -> RDD:
    """Blocks (ids, coordinates as d x rows) of the rows in at most ``tasks`` partitions."""
    cols, most = list(cols), BLOCK

    def pack(batches):  # self-contained, like all task functions here: runs in Python workers without this package installed
        import numpy as np
        import pandas as pd
        for b in batches:
            for a in range(0, len(b), most):
                part = b.iloc[a:a + most]
                x = np.vstack([part[c].to_numpy(dtype=float) for c in cols])
                yield pd.DataFrame({"ids": [part[id_col].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    d = len(cols)

    def unpack(r):
        import numpy as np
        return np.frombuffer(r[0], dtype=np.uint64), np.frombuffer(r[1]).reshape(d, -1)
    packed = df.select(id_col, *cols).mapInPandas(pack, "ids binary, x binary").coalesce(tasks)
    return packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _seed_pass(blocks: RDD, models: list, step: int, seed: int) -> dict:
    """One k-means++ step for every model that still needs a center (all have ``step``); returns model -> new center."""
    ids_of = [mid for mid, _ in models]
    given = np.stack([c for _, c in models], axis=1)  # step x models x d
    rows = ROWS // 2

    def pick(it):
        import numpy as np

        def mixed(x, y):  # an avalanche of 64 bits, in place; y is room for it
            with np.errstate(over="ignore"):
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    np.right_shift(x, np.uint64(shift), out=y)
                    np.bitwise_xor(x, y, out=x)
                    if factor != 1:
                        np.multiply(x, np.uint64(factor), out=x)
            return x

        n, d = len(ids_of), given.shape[2]
        with np.errstate(over="ignore"):
            salt = np.array(ids_of, dtype=np.uint64) + np.uint64(1)
            start = np.array([seed + 1], dtype=np.uint64)
            salt += mixed(start, start.copy())
            salt = mixed(salt, salt.copy()) + np.uint64(step + 1)
            salt = mixed(salt, salt.copy())[:, None]
        flat = given.reshape(step * n, d)
        norm = (flat * flat).sum(axis=1)
        factor = np.hstack([-2.0 * flat, norm[:, None]])
        longest = norm.reshape(step, n).max(axis=0)[:, None] if step else 0.0
        # held for all blocks: they stay in a core's cache
        z_, y_, u_, least_, near_, far_ = (np.empty(n * rows * times, dtype=t) for times, t in (
            (1, np.uint64), (1, np.uint64), (1, float), (1, float), (1, float), (step, float)))
        best, point = np.full(n, -np.inf), None
        for ids, block in it:
            if point is None and len(ids):
                point = np.repeat(block[:, :1].T, n, axis=0)
            own_all, with_one, squares = ids.copy(), np.vstack([block, np.ones((1, len(ids)))]), (block * block).sum(axis=0)
            mixed(own_all, ids.copy())
            for a in range(0, len(ids), rows):
                own, square = own_all[a:a + rows], squares[a:a + rows]
                w = len(own)
                z, y, u, least, far = (held[:n * w].reshape(n, w) for held in (z_, y_, u_, least_, near_))
                mixed(np.bitwise_xor(own[None], salt, out=z), y)
                np.right_shift(z, np.uint64(11), out=z)
                np.copyto(u, z, casting="unsafe")
                u += 0.5
                u *= 2.0 ** -53
                np.subtract(1.0, u, out=least)  # at most -log(u): few rows can have the largest log(u) / far
                if step:
                    each = np.matmul(factor, with_one[:, a:a + rows], out=far_[:step * n * w].reshape(step * n, w)).reshape(step, n, w)
                    np.add(each[0], square, out=far)
                    for i in range(1, step):
                        each[i] += square
                        np.minimum(far, each[i], out=far)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        near = not far.min() >= 1e-6 * (longest.max() + square.max())
                        if near:  # from the differences, where cancellation would show
                            m, j = np.nonzero(far < 1e-6 * (longest + square))
                            far[m, j] = ((given[:, m] - block.T[a + j]) ** 2).sum(axis=2).min(axis=0)
                        least /= far
                        if near:
                            least[~(far > 0)] = np.inf
                open_ = np.flatnonzero((least < (-best * (1 + 1e-9))[:, None]).ravel())
                if not len(open_):
                    continue
                m, j = open_ // w, open_ % w
                key = np.log(u[m, j]) / (far[m, j] if step else 1.0)
                order = np.lexsort((j, -key, m))
                first = order[np.flatnonzero(np.r_[True, m[order][1:] != m[order][:-1]])]  # a model's largest, the first row on ties
                first = first[key[first] > best[m[first]]]
                best[m[first]], point[m[first]] = key[first], block.T[a + j[first]]
        yield {} if point is None else {mid: (float(best[t]), tuple(map(float, point[t]))) for t, mid in enumerate(ids_of)}

    out: dict = {}
    for found in blocks.mapPartitions(pick).collect():  # one candidate per task and model
        for mid, candidate in found.items():
            out[mid] = max(out.get(mid, candidate), candidate)
    return {mid: np.array(p) for mid, (_, p) in out.items()}


def _lloyd_pass(blocks: RDD, models: list) -> dict:
    """Per model the cost and per cluster the count and coordinate sums under the given centers."""
    by_k: dict = {}
    for mid, c in models:
        by_k.setdefault(len(c), []).append((mid, c))
    stacks = [np.stack([c for _, c in group], axis=1) for group in by_k.values()]  # k x models x d each
    rows = ROWS

    def part(it):
        import numpy as np
        factors, most, widest = [], 0, 0
        for centers in stacks:
            k, n, d = centers.shape
            flat = centers.reshape(k * n, d)
            factors.append((k, n, np.hstack([-2.0 * flat, (flat * flat).sum(axis=1)[:, None]])))
            most, widest = max(most, k * n), max(widest, n)
        # held for all blocks: they stay in a core's cache
        far_, member_, closest_, nearest_ = np.empty(most * rows), np.empty(most * rows), np.empty(most * rows, dtype=bool), np.empty(widest * rows)
        added = None
        for _, block in it:
            for a in range(0, block.shape[1], rows):
                x = block[:, a:a + rows]
                m = x.shape[1]
                square = (x * x).sum(axis=0)
                with_one = np.vstack([x, np.ones((1, m))])
                turned = np.ascontiguousarray(with_one.T)
                here = []
                for k, n, factor in factors:
                    far = np.matmul(factor, with_one, out=far_[:k * n * m].reshape(k * n, m)).reshape(k, n, m)  # without the row's own square
                    best = nearest_[:n * m].reshape(n, m)
                    np.copyto(best, far[0])
                    for j in range(1, k):
                        np.minimum(best, far[j], out=best)
                    closest, member = closest_[:k * n * m].reshape(k, n, m), member_[:k * n * m].reshape(k, n, m)
                    np.copyto(member, np.equal(far, best, out=closest))
                    sums = (member.reshape(k * n, m) @ turned).reshape(k, n, -1)
                    tied = np.flatnonzero(sums[:, :, -1].sum(axis=0) != m)
                    if len(tied):  # the first center on ties
                        first = far[:, tied].argmin(axis=0)
                        sums[:, tied] = (first[None] == np.arange(k)[:, None, None]).astype(float) @ turned
                    here.append((sums, np.maximum(best + square, 0.0).sum(axis=1)))
                added = here if added is None else [(s + t, c + e) for (s, c), (t, e) in zip(added, here)]
        if added is not None:
            yield added

    out: dict = {}
    found = blocks.mapPartitions(part).collect()  # a row of d + 1 numbers per task and center
    for i, group in enumerate(by_k.values() if found else ()):
        sums, cost = sum(f[i][0] for f in found), sum(f[i][1] for f in found)
        for r, (mid, _) in enumerate(group):
            out[mid] = (sums[:, r, -1], sums[:, r, :-1], float(cost[r]))
    return out


def fit_batched(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int = 15, seed: int = 42,
                max_iter: int = 500, tol: float = 1e-4, id_col: str | None = None) -> list[KMeansFit]:
    """Fit ``n_init`` k-means++ restarts for every K in ``ks`` with shared data passes.

    A model stops when the total squared shift of its centers is at most
    ``tol`` times the mean per-feature variance; models that stopped leave the
    later passes. ``df`` is read twice, the passes run over its blocks. ``id_col`` is a long that names a row in any
    layout (default: a hash of the coordinates).
    """
    if id_col is None:
        id_col = "_row_id"
        df = df.withColumn(id_col, F.xxhash64(*cols))
    specs = [(int(k), r) for k in ks for r in range(n_init)]
    # convergence as in the reference's K-Means: total squared center shift <= tol * mean feature variance
    var_row = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    tol_abs = tol * float(np.mean([var_row[f"v{i}"] or 0.0 for i in range(len(cols))]))
    blocks = _blocks(df, cols, id_col, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-var_row["n"] // TASK_ROWS)))
    centers = {m: np.zeros((0, len(cols))) for m in range(len(specs))}
    for step in range(max(k for k, _ in specs)):
        need = [(m, centers[m]) for m, (k, _) in enumerate(specs) if len(centers[m]) < k]
        picks = _seed_pass(blocks, need, step, seed)
        for m, p in picks.items():
            centers[m] = np.vstack([centers[m], p[None, :]])
    active = set(range(len(specs)))
    iters = {m: 0 for m in active}
    for _ in range(max_iter):
        if not active:
            break
        stats = _lloyd_pass(blocks, [(m, centers[m]) for m in sorted(active)])
        for m in sorted(active):
            old = centers[m]
            new = old.copy()
            if m in stats:
                n, s, _ = stats[m]
                new[n > 0] = s[n > 0] / n[n > 0, None]  # an empty cluster keeps its center
            iters[m] += 1
            centers[m] = new
            if float(((new - old) ** 2).sum()) <= tol_abs:
                active.discard(m)
    final = _lloyd_pass(blocks, [(m, centers[m]) for m in range(len(specs))])
    blocks.unpersist()
    return [KMeansFit(k, r, centers[m], final[m][2] if m in final else 0.0, iters[m]) for m, (k, r) in enumerate(specs)]


def best_per_k(fits: Sequence[KMeansFit]) -> dict[int, KMeansFit]:
    """Lowest inertia per K (earliest restart on ties)."""
    out: dict[int, KMeansFit] = {}
    for f in fits:
        if f.k not in out or f.inertia < out[f.k].inertia:
            out[f.k] = f
    return out


def assign(cols: Sequence[str], centers: np.ndarray) -> Column:
    """Nearest-center label as a JVM expression (first center on exact ties).

    One fold over the literal centers keeps (index, best distance, argmin), so
    the coordinate expressions appear once in the plan whatever k is -- an
    unrolled per-center expression would be copied into every consumer plan.
    """
    point = F.array(*[F.col(c).cast("double") for c in cols])
    cen = F.array(*[F.array(*[F.lit(float(v)) for v in ctr]) for ctr in centers])

    def step(acc, c):
        d = F.aggregate(F.zip_with(point, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
        better = d < acc["best"]
        return F.struct((acc["i"] + 1).alias("i"), F.when(better, d).otherwise(acc["best"]).alias("best"),
                        F.when(better, acc["i"]).otherwise(acc["arg"]).alias("arg"))

    init = F.struct(F.lit(0).alias("i"), F.lit(float("inf")).alias("best"), F.lit(0).alias("arg"))
    return F.aggregate(cen, init, step, lambda acc: acc["arg"])


def label_rows(df: DataFrame, cols: Sequence[str], models: Mapping[str, np.ndarray]) -> DataFrame:
    """``df`` with one int column per model: the nearest of its centers, as ``assign`` gives it, for all models in one pass.

    The other columns pass through as they are.
    """
    names, given = df.columns, {name: np.asarray(c, dtype=float) for name, c in models.items()}
    at = [names.index(c) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            x = [b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at]
            labels = []
            for centers in given.values():
                best, nearest = np.full(b.num_rows, np.inf), np.zeros(b.num_rows, dtype=np.int32)
                for i, c in enumerate(centers):
                    far = sum((v - w) * (v - w) for v, w in zip(x, c))
                    closer = far < best
                    best[closer], nearest[closer] = far[closer], i
                labels.append(pa.array(nearest))
            yield pa.RecordBatch.from_arrays([*b.columns, *labels], names=[*names, *given])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` int" for name in given])
    return df.mapInArrow(run, fields)
