"""Many logistic fits at a time: rows in blocks against fits in tiles.

A fit belongs to a key and uses the rows of that key, but for those of the members it leaves out. Rows of a key stand in blocks
of about `BLOCK_ROWS`; fits stand in tiles of at most `TILE_FITS`. A task sees one block and one tile and works through them in pieces of
`ROWS` x `FITS`, so its memory does not depend on the number of rows or fits. Coefficients are a table keyed by fit: in every
round each (block, tile) returns its share of the gradients and Hessians, Spark adds them by fit, and the steps are solved
where the sums are. Only the number of open fits comes back to the driver, whatever the number of keys. Where one block holds all rows of a
key, the same steps are repeated in place, and no round is needed.

rows: _key, who (long), y (0 or 1), x (array of doubles, equally long within a key)
fits: _key, fit (long), out (members left out; the last one is held out to be predicted), w (weights of both classes), pen (penalty per input)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.session import checkpointed

BLOCK_ROWS = 16_384
TILE_FITS = 4096
ROWS, FITS = 4096, 256     # what is multiplied at a time
STEPS = 60
TOLERANCE = 1e-8
LONGEST = 20.0             # a longer step is shortened so that the quadratic model stays valid
NOBODY = -1 << 62
HELD = 6                   # log loss, right answers and rows of both classes


def _sig(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


class Blocks:
    """Rows of fits in blocks, written once."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS):
        kept = checkpointed(rows.select("_key", F.col("who").cast("long").alias("who"), F.col("y").cast("double").alias("y"), "x"))
        sizes = kept.groupBy("_key").agg(F.count("*").alias("_n"), F.max(F.size("x")).alias("_d"))
        self.sizes = checkpointed(sizes.select("_key", F.ceil(F.col("_n") / block_rows).cast("long").alias("blocks"), "_d"))
        total, most, inputs = self.sizes.agg(F.sum("blocks"), F.max("blocks"), F.max("_d")).first()
        self.total, self.most, self.inputs = total or 0, most or 0, inputs or 0
        # written rows are read in one order, so the draw is the same whenever a task is repeated
        spread = kept.withColumn("_draw", F.rand(1)).join(self.sizes.drop("_d"), "_key").withColumn("block", F.floor(F.col("_draw") * F.col("blocks")))
        self.rows = checkpointed(spread.groupBy("_key", "block", "blocks").agg(F.collect_list(F.struct("who", "y", "x")).alias("rows")))


class Fits:
    """Fits taken apart for the kernel."""

    def __init__(self, told: list[dict]):
        self.number = np.array([t["fit"] for t in told], np.int64)
        width = max((len(t["out"]) for t in told), default=0)
        self.out = np.array([t["out"] + [NOBODY] * (width - len(t["out"])) for t in told], np.int64).reshape(len(told), width)
        self.held = np.array([t["out"][-1] if t["out"] else NOBODY for t in told], np.int64)
        self.w = np.array([t["w"] for t in told], float)
        self.pen = np.array([[0.0, *t["pen"]] for t in told], float)
        self.beta = np.array([t["beta"] or [0.0] * self.pen.shape[1] for t in told], float)
        self.first = [t["first"] for t in told]

    def __len__(self) -> int:
        return len(self.number)


def _designs(x: np.ndarray, who: np.ndarray, f: Fits, stages: list[tuple[int, int]] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of some fits, their inputs with a leading 1). With `stages` a fit's inputs are the probabilities that first models
    give, one per slice of x; they are the fit's own (`first`: by member, a row of intercepts and coefficients)."""
    one = np.ones((len(x), 1))
    if stages is None:
        z = np.hstack([one, x])
        for a in range(0, len(f), FITS):
            yield np.arange(a, min(a + FITS, len(f))), z
        return
    for k in range(len(f)):
        b = np.array([np.nan if v is None else v for v in f.first[k]], float).reshape(-1, sum(q - p + 1 for p, q in stages))[who]
        parts, at = [one], 0
        for p, q in stages:
            t = b[:, at] + (b[:, at + 1:at + 1 + q - p] * x[:, p:q]).sum(1)
            parts.append(np.where(np.isfinite(t), _sig(t), 0.5)[:, None])
            at += q - p + 1
        yield np.array([k]), np.hstack(parts)


def _sums(z: np.ndarray, y: np.ndarray, who: np.ndarray, f: Fits, at: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient and upper Hessian of the fits `at`, summed over the rows that they use."""
    d = z.shape[1]
    iu = np.triu_indices(d)
    out = np.zeros((len(at), d + len(iu[0])))
    for a in range(0, len(y), ROWS):
        zs, ys, ws = z[a:a + ROWS], y[a:a + ROWS], who[a:a + ROWS]
        p = _sig(zs @ beta.T)
        use = np.where(ys[:, None] == 1, f.w[at, 1], f.w[at, 0])
        for c in range(f.out.shape[1]):
            use = use * (ws[:, None] != f.out[at, c])
        out[:, :d] += (use * (p - ys[:, None])).T @ zs
        out[:, d:] += (use * np.maximum(p * (1 - p), 1e-9)).T @ (zs[:, iu[0]] * zs[:, iu[1]])
    return out


def _stepped(sums: np.ndarray, beta: np.ndarray, pen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients after a Newton step, and its size."""
    n, d = beta.shape
    iu = np.triu_indices(d)
    h = np.zeros((n, d, d))
    h[:, iu[0], iu[1]] = h[:, iu[1], iu[0]] = sums[:, d:d + len(iu[0])]
    h += pen[:, :, None] * np.eye(d) + 1e-12 * np.eye(d)
    g = sums[:, :d] + pen * beta
    try:
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        step = (np.linalg.pinv(h, hermitian=True) @ g[:, :, None])[:, :, 0]
    size = np.abs(step).max(1)
    return beta - step * np.minimum(1.0, LONGEST / np.maximum(size, 1e-12))[:, None], size


def _held(z: np.ndarray, y: np.ndarray, who: np.ndarray, f: Fits, at: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """What the fits `at` say of the rows that they hold out: see `HELD`."""
    out = np.zeros((len(at), HELD))
    order = np.argsort(who, kind="stable")
    members = who[order]
    for m in np.unique(f.held[at][f.held[at] != NOBODY]):
        rows = order[np.searchsorted(members, m):np.searchsorted(members, m, "right")]
        mine = np.flatnonzero(f.held[at] == m)
        t = z[rows] @ beta[mine].T
        p = np.clip(_sig(t), K.P_CLIP, 1 - K.P_CLIP)
        for cls in (0, 1):
            of = y[rows] == cls
            out[mine, cls] += -np.log(p[of] if cls else 1 - p[of]).sum(0)
            out[mine, 2 + cls] += ((t[of] >= 0) == cls).sum(0)
            out[mine, 4 + cls] += of.sum()
    return out


def _doubles(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))


def _grid(blocks: Blocks, fits: DataFrame) -> DataFrame:
    """Every block with every tile of its key's fits: _key, blocks, rows, fits."""
    told = fits.groupBy("_key").agg(F.count("*").alias("_f")).join(blocks.sizes.select("_key", "blocks"), "_key")
    # few keys are cut into more tiles, so that all tasks have work
    wanted = F.lit(-(-64 // max(1, blocks.total)))
    tiles = F.greatest(F.ceil(F.col("_f") / TILE_FITS), F.least(wanted, F.ceil(F.col("_f") / 16))).cast("long")
    told = told.select("_key", "blocks", tiles.alias("tiles"))
    tile = (fits.join(told, "_key").withColumn("tile", F.pmod(F.xxhash64("fit"), F.col("tiles")))
            .groupBy("_key", "tile", "blocks").agg(F.collect_list(F.struct("fit", "out", "w", "pen", "beta", "first")).alias("fits"))
            .select("_key", "tile", "fits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")))
    block = blocks.rows.join(told.select("_key", "tiles"), "_key").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return block.join(tile, ["_key", "block", "tile"]).select("_key", "blocks", "rows", "fits")


def _work(grid: DataFrame, kind: str, stages, steps: int) -> DataFrame:
    """One row per fit and cell of the grid: `solve` gives coefficients and held-out values, `sums` shares of a step, `held`
    held-out values of given coefficients."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.slice(i, 1)
                who, y, x = cell.column("rows")[0].values.flatten()
                who, y = who.to_numpy(), y.to_numpy()
                x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1)
                f = Fits(cell.column("fits")[0].as_py())
                beta, values = f.beta.copy(), [None] * len(f)
                for at, z in _designs(x, who, f, stages):
                    if kind == "sums":
                        for k, v in zip(at, _sums(z, y, who, f, at, beta[at])):
                            values[k] = v
                        continue
                    if kind == "solve":
                        open_ = at
                        for _ in range(steps):
                            beta[open_], size = _stepped(_sums(z, y, who, f, open_, beta[open_]), beta[open_], f.pen[open_])
                            open_ = open_[size >= TOLERANCE]
                            if not len(open_):
                                break
                    for k, v in zip(at, _held(z, y, who, f, at, beta[at])):
                        values[k] = v
                key = cell.column("_key").take(pa.array(np.zeros(len(f), np.int64)))
                yield pa.RecordBatch.from_arrays([key, pa.array(f.number), _doubles(list(beta)), _doubles(values)], ["_key", "fit", "beta", "v"])

    kind_of_key = grid.schema["_key"].dataType.simpleString()
    return grid.mapInArrow(run, f"_key {kind_of_key}, fit long, beta array<double>, v array<double>")


def _added(cells: DataFrame, width: int) -> DataFrame:
    """_key, fit, v: shares added up by fit."""
    return cells.groupBy("_key", "fit").agg(F.array(*[F.sum(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))) for i in range(width)]).alias("v"))


def _solved(open_: DataFrame) -> DataFrame:
    """One Newton step for every row: _key, fit, beta, pen, v."""
    names = [c for c in open_.columns if c not in ("v", "beta", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beta, size = [], []
            for b, p, v in zip(*(batch.column(c).to_pylist() for c in ("beta", "pen", "v"))):
                d = len(p) + 1
                after, s = _stepped(np.array([v[:d + d * (d + 1) // 2]]), np.array([b or [0.0] * d]), np.array([[0.0, *p]]))
                beta.append(after[0])
                size.append(s[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _doubles(beta), pa.array(size, pa.float64())], [*names, "beta", "size"])

    kinds = ", ".join(f"`{c}` {open_.schema[c].dataType.simpleString()}" for c in names)
    return open_.mapInArrow(run, f"{kinds}, beta array<double>, size double")


def fit(blocks: Blocks, fits: DataFrame, *, stages: list[tuple[int, int]] | None = None, steps: int = STEPS) -> DataFrame:
    """_key, fit, beta (intercept first, not penalised) and held (see `HELD`) of every fit whose key has rows."""
    if "first" not in fits.columns:
        fits = fits.withColumn("first", F.lit(None).cast("array<double>"))
    fits = checkpointed(fits.withColumn("fit", F.col("fit").cast("long")).withColumn("beta", F.lit(None).cast("array<double>")))
    alone = blocks.sizes.filter("blocks = 1").select("_key")
    done = _work(_grid(blocks, fits.join(alone, "_key", "left_semi")), "solve", stages, steps).select("_key", "fit", "beta", F.col("v").alias("held"))
    if blocks.most <= 1:
        return done
    d = 1 + (len(stages) if stages is not None else blocks.inputs)
    width = d + d * (d + 1) // 2
    many = blocks.sizes.filter("blocks > 1").select("_key")
    t = checkpointed(fits.join(many, "_key", "left_semi").withColumn("size", F.lit(float("inf"))))
    for _ in range(steps):
        open_ = t.filter(F.col("size") >= TOLERANCE)
        shares = _added(_work(_grid(blocks, open_), "sums", stages, steps), width)
        moved = _solved(open_.join(shares, ["_key", "fit"]))
        t = checkpointed(moved.select(*t.columns).unionByName(t.filter(F.col("size") < TOLERANCE)))
        if not t.filter(F.col("size") >= TOLERANCE).count():
            break
    held = _added(_work(_grid(blocks, t), "held", stages, steps), HELD)
    return done.unionByName(t.select("_key", "fit", "beta").join(held.withColumnRenamed("v", "held"), ["_key", "fit"]))
