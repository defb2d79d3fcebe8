"""Exact top-k inner-product search over a vector-approximation file.

Components become integers floor(256 x).  The VA-file holds for each vector one cell
number of CELL_BITS bits per component; the cells of a component end at quantiles of a
sample of about SAMPLE_COMPONENTS components (hash of the row number), its outer cells at
the least and the largest value of all rows.  A scan of the cells bounds every score
from below and above; candidates are vectors whose upper bound reaches the k-th lower
bound.  Exact vectors are then read in the order of their bounds: first the k best
bounds of each query, and, once these give a k-th exact score, those whose bound still
reaches it.

Queries and cells are packed into blocks of bounded size.  Groups of query blocks meet
shares of the cell blocks in tasks of a join: neither side passes through the driver.
Every row has a stored number by which it is bounded, scored and joined.  Of equal
vectors only k rows of each id, and of these the 2k rows with the smallest ids, can ever
be results: a query skips at most k rows of its own id.  Longer groups of copies are cut
to these.

Defined results: vectors that are null, or hold null or non-finite components, take no
part, nor do rows without vec_id; components beyond +-2**62 / 256 count as that bound, and
a score beyond a long as the nearest long; only vectors of one length are compared, those
of length 0 with score 0; a query is its vec_id, and rows with that vec_id are no
candidates of it; each row of a repeated vec_id is a candidate of its own; equal rows of
a query are one query, and where a query's rows differ, a candidate row has the highest
of its scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import small_batches, stored

CELL_BITS = 6
SAMPLE_COMPONENTS = 1 << 20
BLOCK_BYTES = 1 << 20
GROUP_BLOCKS = 8
SHARE_BLOCKS = 64
SPREAD = 64
SLICE = 1024
HELD_CANDIDATES = 1 << 17
LARGEST = 1 << 62
LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, v (array<long> of floor(256 x)) of the vectors that take part."""
    bad = "exists(embedding, x -> x is null or isnan(x) or abs(cast(x as double)) = double('Infinity'))"
    whole = f"greatest(least(floor(256 * cast(x as double)), {LARGEST}), -{LARGEST})"
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .filter(f"vec_id is not null and embedding is not null and not {bad}")
        .select(
            "vec_id",
            F.size("embedding").alias("dims"),
            F.expr(f"transform(embedding, x -> cast({whole} as long))").alias("v"),
        )
    )


# ---------------------------------------------------------------- cells


def _by_dims(batch):
    """dims, row numbers, ids and vectors (rows x dims) of each length in a batch."""
    dims, values = np.asarray(batch.column("dims")), batch.column("v")
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        flat = np.asarray(values.take(pa.array(mine)).flatten(), np.int64)
        rows, ids = (np.asarray(batch.column(c))[mine] for c in ("row", "vec_id"))
        yield d, rows, ids, flat.reshape(len(mine), d)


def _ends(batches):
    found: dict[int, tuple] = {}
    for batch in batches:
        for d, _, _, v in _by_dims(batch):
            low, high = v.min(0), v.max(0)
            if d in found:
                low, high = np.minimum(low, found[d][0]), np.maximum(high, found[d][1])
            found[d] = low, high
    if found:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(found), pa.int32()),
                pa.array([f[0].tolist() for f in found.values()], pa.list_(pa.int64())),
                pa.array([f[1].tolist() for f in found.values()], pa.list_(pa.int64())),
            ],
            names=["dims", "low", "high"],
        )


class Grid:
    """Cells of the components of one vector length: inner edges, middles and half widths."""

    def __init__(self, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        cells = 1 << CELL_BITS
        if len(sample):
            inner = np.sort(sample, axis=0)[(np.arange(1, cells) * len(sample)) // cells].T
        else:
            step = (high.astype(float) - low) / cells
            inner = (low[:, None] + step[:, None] * np.arange(1, cells)).astype(np.int64)
        self.inner = np.clip(inner, low[:, None], high[:, None])
        first = np.hstack([low[:, None], self.inner]).astype(float)
        last = np.hstack([self.inner, high[:, None]]).astype(float)
        self.middle, self.half = (first + last) / 2, (last - first) / 2
        self.most = np.maximum(np.abs(low.astype(float)), np.abs(high.astype(float)))
        self.at = np.arange(len(low)) * cells

    def codes(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(v.shape, np.uint8)
        for j in range(v.shape[1]):
            out[:, j] = np.searchsorted(self.inner[j], v[:, j], side="right")
        return out

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half widths of the cells; the edges of a cell belong to it on both sides."""
        at = codes + self.at
        return self.middle.ravel()[at], self.half.ravel()[at]


def grids(rows: DataFrame) -> dict[int, Grid]:
    """The cells of each vector length."""
    ends = rows.mapInArrow(_ends, "dims int, low array<long>, high array<long>")
    ends = ends.select("dims", F.posexplode(F.arrays_zip("low", "high")).alias("at", "e"))
    ends = ends.groupBy("dims", "at").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).toArrow()
    total = rows.agg(F.sum("dims")).first()[0] or 0
    share = min(1 << 20, -(-SAMPLE_COMPONENTS * (1 << 20) // max(1, total)))
    sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < share).select("row", "vec_id", "dims", "v").toArrow()
    samples: dict[int, list] = {}
    for batch in sample.to_batches():
        for d, _, _, v in _by_dims(batch):
            samples.setdefault(d, []).append(v)
    none = np.empty(0, np.int64)
    found = {0: Grid(none, none, np.empty((0, 0)))}
    dims, at = ends.column("dims").to_numpy(), ends.column("at").to_numpy()
    low, high = ends.column("low").to_numpy(), ends.column("high").to_numpy()
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        mine = mine[np.argsort(at[mine])]
        found[d] = Grid(low[mine], high[mine], np.vstack(samples[d]) if d in samples else np.empty((0, d)))
    return found


def _blocks(dims: int, width: int, rows, ids, values):
    """Blocks of at most BLOCK_BYTES: row numbers, ids and values as bytes."""
    size = max(1, BLOCK_BYTES // max(1, dims * width))
    cuts = range(0, len(rows), size)
    parts = [[x[a : a + size].tobytes() for a in cuts] for x in (rows, ids, values)]
    return pa.RecordBatch.from_arrays(
        [pa.array([dims] * len(cuts), pa.int32()), *(pa.array(p, pa.binary()) for p in parts)],
        names=["dims", "rows", "ids", "values"],
    )


def _packed(sent):
    """Blocks of cell numbers, or of whole vectors where no cells are sent."""

    def flush(held, d):
        rows, ids, values = (np.concatenate(x) for x in zip(*held.pop(d)))
        return _blocks(d, values.itemsize, rows, ids, values)

    def run(batches):
        cells = sent.value if sent else None
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            for d, rows, ids, v in _by_dims(batch):
                values = cells[d].codes(v) if cells else v.astype(np.float64)
                held.setdefault(d, []).append((rows, ids, values))
                sizes[d] = sizes.get(d, 0) + values.nbytes
                if sizes[d] >= BLOCK_BYTES:
                    yield flush(held, d)
                    sizes[d] = 0
        for d in list(held):
            yield flush(held, d)

    return run


BLOCK = "dims int, rows binary, ids binary, values binary"


# ---------------------------------------------------------------- bounds


class _Scan:
    """Bounds of one block of queries: running k-th lower bounds and the candidates above them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int, grid: Grid):
        self.rows, self.values, self.size, self.k, self.grid = rows, values, np.abs(values), k, grid
        # More than floating-point sums can be off.
        self.error = self.size @ grid.most * (values.shape[1] + 2) * 2.0**-51
        self.best = np.full((len(rows), k), -np.inf)
        self.place: dict[int, list[int]] = {}
        for n, i in enumerate(ids.tolist()):
            self.place.setdefault(i, []).append(n)
        self.held: list[tuple] = []
        self.n_held = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray):
        """Scan a block of cells; yields candidates where more than HELD_CANDIDATES stay open."""
        for low in range(0, len(rows), SLICE):
            part = slice(low, low + SLICE)
            middle, half = self.grid.spans(codes[part])
            own = [(q, n) for n, i in enumerate(ids[part].tolist()) for q in self.place.get(i, ())]
            for at in range(0, len(self.rows), SLICE):
                to = at + SLICE
                score, slack = self.values[at:to] @ middle.T, self.size[at:to] @ half.T
                slack += self.error[at:to, None]
                for q, n in own:
                    if at <= q < to:
                        score[q - at, n] = -np.inf
                lower = score - slack
                top = lower if lower.shape[1] <= self.k else np.partition(lower, -self.k, axis=1)[:, -self.k :]
                self.best[at:to] = np.sort(np.hstack([self.best[at:to], top]), axis=1)[:, -self.k :]
                score += slack
                q, n = np.nonzero((score >= self.best[at:to, :1]) & (score > -np.inf))
                self.held.append((q + at, rows[part][n], lower[q, n], score[q, n]))
                self.n_held += len(q)
        if self.n_held > HELD_CANDIDATES:
            self._thin()
            if self.n_held > HELD_CANDIDATES // 2:
                yield self.found()

    def _thin(self) -> None:
        q, n, low, high = (np.concatenate(c) for c in zip(*self.held))
        keep = high >= self.best[q, 0]
        self.held, self.n_held = [(q[keep], n[keep], low[keep], high[keep])], int(keep.sum())

    def found(self) -> pa.RecordBatch:
        self._thin()
        q, n, low, high = self.held[0]
        self.held, self.n_held = [], 0
        names = ["query", "row", "lower", "upper"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.rows[q], n, low, high)], names=names)


def _candidates(sent, k: int):
    def run(batches):
        scans: dict[int, _Scan] = {}
        for batch in batches:
            for pair in batch.to_pylist():
                d, block = pair["dims"], pair["query_block"]
                if block not in scans:
                    if len(scans) >= 2 * GROUP_BLOCKS:
                        old = scans.pop(next(iter(scans)))
                        if old.held:
                            yield old.found()
                    rows, ids = (np.frombuffer(pair[c], np.int64) for c in ("query_rows", "query_ids"))
                    values = np.frombuffer(pair["query_values"], np.float64).reshape(len(rows), d)
                    scans[block] = _Scan(rows, ids, values, k, sent.value[d])
                rows, ids = (np.frombuffer(pair[c], np.int64) for c in ("rows", "ids"))
                yield from scans[block].add(rows, ids, np.frombuffer(pair["values"], np.uint8).reshape(len(rows), d))
        for scan in scans.values():
            if scan.held:
                yield scan.found()

    return run


def bounds(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, row, lower, upper: the candidates of each query among the rows, by their cells."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(grids(rows))
    cells = stored(
        rows.mapInArrow(_packed(sent), BLOCK).withColumn("block", F.monotonically_increasing_id()), "approximations"
    )
    asked = stored(
        queries.mapInArrow(_packed(None), BLOCK).withColumn("query_block", F.monotonically_increasing_id()), "queries"
    )
    n_cells, n_asked = cells.count(), asked.count()
    groups = max(1, -(-n_asked // GROUP_BLOCKS))
    width = min(SPREAD, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = max(1, min(n_cells, max(-(-n_cells // SHARE_BLOCKS), -(-width // groups))))
    left = cells.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares))).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = asked.select(
        "dims",
        "query_block",
        F.pmod(F.xxhash64("query_block"), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.expr(f"sequence(0L, {shares - 1}L)")).alias("share"),
        *(F.col(c).alias(f"query_{c}") for c in ("rows", "ids", "values")),
    )
    pairs = left.drop("block").join(right, ["dims", "group", "share"])
    return pairs.mapInArrow(_candidates(sent, k), "query long, row long, lower double, upper double")


# ---------------------------------------------------------------- exact scores


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """query, name: the k-th largest value of each query that has k."""
    order = Window.partitionBy("query").orderBy(F.desc(value))
    ranked = rows.select("query", value, F.row_number().over(order).alias("_n")).filter(f"_n <= {k}")
    return ranked.filter(f"_n = {k}").select("query", F.col(value).alias(name))


_PRODUCT = "aggregate(zip_with(v, q, (a, b) -> a * b), 0L, (s, x) -> s + x)"
_REACH = "aggregate(zip_with(v, q, (a, b) -> abs(double(a) * b)), 0D, (s, x) -> s + x)"
_WIDE = "aggregate(zip_with(v, q, (a, b) -> cast(a as decimal(19,0)) * cast(b as decimal(19,0))), cast(0 as decimal(38,0)), (s, x) -> try_add(s, x))"
_SIGN = f"if(aggregate(zip_with(v, q, (a, b) -> double(a) * b), 0D, (s, x) -> s + x) > 0, {LONG}, -{LONG} - 1)"
SCORE = (
    f"case when {_REACH} < 9e18 then {_PRODUCT} "
    f"else coalesce(cast(greatest(least({_WIDE}, {LONG}), -{LONG} - 1) as long), {_SIGN}) end"
)


def _exact(wanted: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """wanted (query, row, ...) with the ids and the exact score."""
    return wanted.join(vectors.select("row", "vec_id", "v"), "row").join(queries, "query").select(
        "query", "query_id", "row", "vec_id", F.expr(SCORE).alias("score")
    )


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to smaller vec_id.

    vectors: vec_id, embedding.  is_query: condition on vec_id that names the queries.
    """
    small_batches(vectors.sparkSession)
    all_rows = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "integers")
    repeat = Window.partitionBy("v", "vec_id").orderBy("row")
    copy = Window.partitionBy("v").orderBy("vec_id", "row")
    few = all_rows.withColumn("_n", F.row_number().over(repeat)).filter(f"_n <= {k}")
    rows = stored(few.withColumn("_n", F.row_number().over(copy)).filter(f"_n <= {2 * k}").drop("_n"), "candidates")
    queries = stored(all_rows.filter(is_query).groupBy("vec_id", "dims", "v").agg(F.min("row").alias("row")), "asked")
    found = stored(bounds(rows, queries, k), "bounds")
    open_ = found.join(_kth(found, "lower", k, "least"), "query", "left").filter(
        "least is null or upper >= least"
    )
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    waves = stored(open_.withColumn("_n", F.row_number().over(order)), "ordered")
    query_rows = queries.select(
        F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")
    )
    first = stored(_exact(waves.filter(f"_n <= {k}"), rows, query_rows), "first")
    second = waves.filter(f"_n > {k}").join(_kth(first, "score", k, "certain"), "query").filter("upper >= certain")
    scores = first.unionByName(_exact(second, rows, query_rows))
    scores = scores.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(f"rank <= {k}").select(
        "query_id", "rank", "vec_id", "score"
    )
