"""Operator 3: exact top-k inner products by pivot-table elimination.

A table in the shared folder has for each vector its integer components, its square norm and its distances
to PIVOTS pivots (farthest-first among at most SAMPLE vectors with the smallest hash; pivots and sample change
the speed, never the result). For a query q and a vector x, max over pivots of |d(q, p) - d(x, p)| bounds their
distance from below, so (|q|^2 + |x|^2 - bound^2) / 2 bounds their inner product from above. A query's k-th best
score within the sample is a floor that its k-th best of all cannot be below.

Queries are dealt into blocks of about QUERIES by their nearest pivots. A block is known by the ranges of its
queries' distances, its largest norm and its smallest floor (some 600 bytes for QUERIES queries), and a vector that
no query of a block can want does not meet that block. All others meet it in one shuffle, in `parts` for each block
so that tasks stay small: a task takes a block's queries, and vectors stream by. For each query those of a batch
are scored in the order of their bounds, until the bound falls below the floor or the k-th best score so far. A
part gives at most k rows a query; these meet in a window over the query.

Defined results: vectors that are null, or hold a null or non-finite component (also one that the scale makes so),
or have a null vec_id take no part; products are exact whatever their size, and one of a result that a long cannot
hold is an error; a shorter vector counts as padded with zeros; equal scores go by the smaller vec_id; of several
query rows with one vec_id one asks, that with the smallest packed components; rows with the query's vec_id are
its own; repeated candidates each count; no candidates give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, table

K = 10
SCALE = 1024.0
PIVOTS = 32
SAMPLE = 1024
QUERIES = 4096
#: Vectors in a part of a block at least and at most, about; between them there are as many as shuffle partitions.
PART = (8192, 1 << 20)
_BLOCK = 8192
_STEP = 128
_TABLE = "vec_id long, v binary, norm double, pivots binary"


def integers(vector, scale: float = SCALE) -> np.ndarray | None:
    """floor(scale * x) of each component, as a whole double; None if the vector takes no part."""
    if vector is None:
        return None
    with np.errstate(over="ignore"):
        x = np.floor(scale * np.array([np.nan if c is None else c for c in vector], dtype=np.float64))
    return x if np.isfinite(x).all() else None


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Padded on either side to the wider of both."""
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = _wide(x, width), _wide(pivots, width)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first."""
    if not len(sample):
        return sample
    with np.errstate(over="ignore"):
        at = [int(np.argmax((sample**2).sum(axis=1)))]
    near = distances(sample, sample[at])[:, 0]
    while len(at) < min(n, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[at[-1:]])[:, 0])
    return sample[at]


def _build(pivots: np.ndarray, scale: float):
    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = integers(v, scale)
                if x is not None and i is not None:
                    ids.append(i)
                    rows.append(x)
            if not rows:
                continue
            x = _padded(rows, max(map(len, rows)))
            d = distances(x, pivots)
            with np.errstate(over="ignore"):
                norm = (x**2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary()),
                    pa.array(norm),
                    pa.array([r.tobytes() for r in d], pa.binary()),
                ],
                names=["vec_id", "v", "norm", "pivots"],
            )

    return run


def _unpack(ids, blobs, norms, pivots):
    rows = [np.frombuffer(b, dtype="<f8") for b in blobs]
    x = _padded(rows, max(map(len, rows)))
    d = np.stack([np.frombuffer(b) for b in pivots])
    return np.array(ids, dtype=np.int64), x, np.array(norms, dtype=np.float64), d


def _dot(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ q).astype(np.int64)
    q = [int(c) for c in q]
    return np.array([sum(int(a) * b for a, b in zip(row, q)) for row in x] + [None], dtype=object)[:-1]


def _exact(norms: float) -> bool:
    """By Cauchy and Schwarz every partial sum is below 2^53 where the product of the square norms is below 2^104."""
    return norms < 2.0**104


def _above(norm_q, norm, bound):
    """Not below the inner product: rounding stays far below this share of the square norms."""
    with np.errstate(over="ignore", invalid="ignore"):
        up = (norm_q + norm - bound * bound) * 0.5 + (norm_q + norm) * 1e-9 + 1
    return np.where(np.isfinite(up), up, np.inf)


def _gap(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row the largest distance of a pivot distance from its range."""
    with np.errstate(invalid="ignore"):
        gap = np.maximum(np.maximum(low - d, d - high), 0).max(axis=1, initial=0)
    return np.where(np.isfinite(gap), gap, 0)


def _asked(sample: tuple[np.ndarray, np.ndarray], k: int, cells: int):
    """Queries -> also floor, the k-th best score within the sample, and cell, the nearest of the first pivots."""
    sid, sx = sample
    top = float((sx**2).sum(axis=1).max(initial=0))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, norm, d = _unpack(*(batch.column(i).to_pylist() for i in range(4)))
            width = max(x.shape[1], sx.shape[1])
            scores = _wide(x, width) @ _wide(sx, width).T
            scores = np.where(ids[:, None] == sid[None, :], -np.inf, scores)
            floor = np.sort(scores, axis=1)[:, -k] if len(sid) >= k else np.full(len(ids), -np.inf)
            floor = np.where(_exact(norm * top), floor, -np.inf)
            cell = np.nan_to_num(d[:, :cells], nan=0).argmin(axis=1) if d.shape[1] else np.zeros(len(ids), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "floor", "cell"])

    return run


def _ranges(batches):
    """Queries -> for each block of a batch the ranges of distances, the largest norm and the smallest floor."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, floor = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        norm, d = np.asarray(batch.column(2)), np.stack([np.frombuffer(b) for b in batch.column(3).to_pylist()])
        blocks = np.unique(block)
        at = [np.flatnonzero(block == b) for b in blocks]
        cols = [blocks, [floor[a].min() for a in at], [norm[a].max() for a in at], [d[a].min(axis=0).tolist() for a in at], [d[a].max(axis=0).tolist() for a in at]]
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["block", "floor", "norm", "low", "high"])


def _meet(stats, parts: int):
    """Vectors -> a row for each block that may want one, dealt in turn to the block's parts."""
    blocks, floors, norms, lows, highs = stats

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            norm = np.asarray(batch.column(2))
            d = np.stack([np.frombuffer(b) for b in batch.column(3).to_pylist()])
            for k, block in enumerate(blocks):
                at = np.flatnonzero(_above(norms[k], norm, _gap(d, lows[k], highs[k])) >= floors[k])
                if len(at):
                    rows = batch.take(pa.array(at))
                    n = len(at)
                    part = (turn + np.arange(n)) % parts
                    turn += n
                    cols = [pa.array(np.full(n, block)), pa.array(part.astype(np.int32)), pa.array(np.ones(n, dtype=np.int32)), *rows.columns, pa.nulls(n, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["block", "part", "kind", *rows.schema.names, "floor"])

    return run


class _Best:
    """A block's queries and their best rows so far."""

    def __init__(self, rows: pa.Table, k: int):
        self.ids, self.x, self.norm, self.d = _unpack(*(rows.column(i).to_pylist() for i in range(4)))
        self.floor, self.k = np.asarray(rows.column(4)), k
        self.score = [np.zeros(0, dtype=np.int64) for _ in self.ids]
        self.who = [np.zeros(0, dtype=np.int64) for _ in self.ids]

    def least(self, j: int):
        return max(self.floor[j], self.score[j][-1]) if len(self.score[j]) == self.k else self.floor[j]

    def take(self, cid, x, norm, d) -> None:
        width = max(x.shape[1], self.x.shape[1])
        x, asks = _wide(x, width), _wide(self.x, width)
        top = norm.max()
        for j in range(len(self.ids)):
            up = _above(self.norm[j], norm, _gap(d, self.d[j], self.d[j]))
            at = np.flatnonzero((up >= self.least(j)) & (cid != self.ids[j]))
            exact = _exact(self.norm[j] * top)
            at = at[np.argsort(-up[at], kind="stable")]
            for s in range(0, len(at), _STEP):
                own = at[s : s + _STEP]
                if up[own[0]] < self.least(j):
                    break
                self.add(j, cid[own], _dot(x[own], asks[j], exact))

    def add(self, j: int, who: np.ndarray, score: np.ndarray) -> None:
        score, who = np.concatenate([self.score[j], score]), np.concatenate([self.who[j], who])
        if score.dtype == object:
            order = sorted(range(len(who)), key=lambda i: (-score[i], who[i]))[: self.k]
        else:
            order = np.lexsort((who, -score))[: self.k]
        self.score[j], self.who[j] = score[order], who[order]

    def rows(self):
        n = [len(b) for b in self.who]
        if not sum(n):
            return
        try:
            score = np.array([int(s) for b in self.score for s in b], dtype=np.int64)
        except OverflowError:
            raise ArithmeticError("an inner product is beyond 64 bits; use a smaller scale") from None
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate(self.who)), pa.array(score)], names=["query_id", "vec_id", "score"])


def _scan(k: int):
    """Rows in order of block, part and kind: a block's queries come first, then the vectors that it meets."""

    def run(batches):
        now, asks, best = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if lo == hi:
                    continue
                if (where := tuple(key[lo, :2])) != now:
                    if best is not None:
                        yield from best.rows()
                    now, asks, best = where, [], None
                rows = batch.slice(lo, hi - lo).select(["vec_id", "v", "norm", "pivots", "floor"])
                if key[lo, 2] == 0:
                    asks.append(rows)
                    continue
                best = best or _Best(pa.Table.from_batches(asks), k)
                for s in range(0, rows.num_rows, _BLOCK):
                    some = rows.slice(s, _BLOCK)
                    best.take(*_unpack(*(some.column(i).to_pylist() for i in range(4))))
        if best is not None:
            yield from best.rows()

    return run


def top_products(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that `is_query` (a Column) holds for, against all rows."""
    spark = vectors.sparkSession
    both = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    sample = both.where("vec_id is not null and x is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    rows = [(r.vec_id, y) for r in sample.collect() if (y := integers(r.x, scale)) is not None]
    taken = _padded([y for _, y in rows], max((len(y) for _, y in rows), default=1))
    pivots = choose_pivots(taken)
    kept = Kept(both.mapInArrow(_build(pivots, scale), _TABLE), "pivot-table").df
    asked = kept.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).join(kept, ["vec_id", "v"]).dropDuplicates(["vec_id"]).select(*kept.columns)
    asked = Kept(asked, "asked").df
    total, asking = kept.count(), asked.count()
    cells = min(max(1, asking // QUERIES), max(1, len(pivots)))
    told = Kept(asked.mapInArrow(_asked((np.array([i for i, _ in rows], dtype=np.int64), taken), k, cells), _TABLE + ", floor double, cell long"), "floors").df
    # As many blocks as the queries of a cell need; there are at most PIVOTS cells.
    many = F.lit(1)
    for r in told.groupBy("cell").count().collect():
        many = F.when(F.col("cell") == r.cell, -(-r["count"] // QUERIES)).otherwise(many)
    told = told.withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), many))
    ranges = told.select("block", "floor", "norm", "pivots").mapInArrow(_ranges, "block long, floor double, norm double, low array<double>, high array<double>")
    of = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(len(pivots))]).alias(c)
    # A row of some 600 bytes for each QUERIES queries.
    found = ranges.groupBy("block").agg(F.min("floor").alias("floor"), F.max("norm").alias("norm"), of(F.min, "low"), of(F.max, "high")).collect()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    stats = [[r[c] for r in found] for c in ("block", "floor", "norm")] + [[np.array(r[c], dtype=np.float64) for r in found] for c in ("low", "high")]
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-total // PART[1]), min(-(-total // PART[0]), -(-wide // len(found))))
    cols = ["block", "part", "kind", *kept.columns, "floor"]
    queries = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0)).select(*cols)
    meet = kept.mapInArrow(_meet(stats, parts), "block long, part int, kind int, " + _TABLE + ", floor double").select(*cols)
    rows = queries.union(meet).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    best = rows.mapInArrow(_scan(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
