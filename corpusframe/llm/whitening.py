"""Whitening of embeddings from covariances that are exact: integers in limbs through float64 products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Bits of a limb and rows of one product: sums of ROWS products of two limbs stay under 2^53.
BITS, ROWS = 16, 4096
#: Components given.
K = 8
#: Entries become floor(SCALE * c) + SHIFT; those beyond 2^62 are held there.
SCALE, SHIFT, MOST = 1024.0, 100_000, 1 << 62
#: Sums travel as three words of this many bits, so that Spark's decimals add them without a limit.
WORD = 60


def limbs(x: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """x as a sum of limbs[i] << (bits * i): all but the last lie in [0, 2^bits), the last is signed
    and smaller than 2^bits in size."""
    out = []
    while len(x) and (x.max() >= 1 << bits or x.min() <= -(1 << bits)):
        out.append(x & ((1 << bits) - 1))
        x = x >> bits
    return [*out, x]


class Gram:
    """The exact sums of x and of x x^T over rows of integers."""

    def __init__(self, dims: int):
        self.n, self.dims = 0, dims
        self.sums = np.zeros(dims, dtype=object)
        self.squares = np.zeros((dims, dims), dtype=object)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), ROWS):
            parts = [p.astype(np.float64) for p in limbs(x[at : at + ROWS])]
            for i, p in enumerate(parts):
                self.sums += p.sum(axis=0).astype(np.int64).astype(object) << BITS * i
            held: dict[int, np.ndarray] = {}
            for (i, p), (j, q) in itertools.product(enumerate(parts), repeat=2):
                held[i + j] = held.get(i + j, 0) + (p.T @ q).astype(np.int64)
            for shift, s in held.items():
                self.squares += s.astype(object) << BITS * shift
        self.n += len(x)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, value): products for i <= j, sums at i = -1, the number of rows at -1, -1."""
        yield -1, -1, self.n
        for j, s in enumerate(self.sums):
            yield -1, j, int(s)
        for i in range(self.dims):
            for j in range(i, self.dims):
                yield i, j, int(self.squares[i, j])


def words(v: int) -> tuple[int, int, int]:
    return v & ((1 << WORD) - 1), v >> WORD & ((1 << WORD) - 1), v >> 2 * WORD


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of floor(SCALE * c) + SHIFT; a vector shorter than dims goes on with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    c = np.zeros((len(sizes), dims))
    c[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -float(MOST), float(MOST - SHIFT * 16)).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    odd = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vec_col).isNotNull()).where(~odd)


@dataclass
class Model:
    """What a fit knows: rows, exact sums, eigenvalues (falling), unit eigenvectors as columns,
    the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace if self.trace else 0.0 for e in self.values]

    @property
    def scales(self) -> np.ndarray:
        """One over the root of each eigenvalue; 0 for a direction without variance."""
        least = len(self.sums) * np.finfo(float).eps * max(self.values, default=0.0)
        return np.array([1 / np.sqrt(e) if e > least else 0.0 for e in self.values])


def fit(vectors: DataFrame, vec_col: str = "embedding", k: int = K) -> Model:
    """The covariance's first k components over all usable rows.

    Every task multiplies its rows limb by limb, exactly, and hands on one integer for each pair of
    dimensions; Spark adds these by pair. The driver gets their sums only, as many as there are
    pairs of dimensions, whatever the number of rows."""
    good = usable(vectors, vec_col).select(F.col(vec_col).alias("v"))
    dims = good.agg(F.max(F.size("v"))).first()[0] or 0
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(f"w{k}", pa.int64()) for k in range(3)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(dims)
        for batch in batches:
            gram.add(integers(batch.column(0), dims))
        if gram.n:
            made = [(i, j, *words(v)) for i, j, v in gram.rows()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    parts = good.mapInArrow(run, "i int, j int, w0 long, w1 long, w2 long")
    total = [F.sum(F.col(f"w{k}").cast("decimal(20,0)")).alias(f"w{k}") for k in range(3)]
    got = {(r.i, r.j): int(r.w0) + (int(r.w1) << WORD) + (int(r.w2) << 2 * WORD) for r in parts.groupBy("i", "j").agg(*total).collect()}
    n, sums = got.get((-1, -1), 0), [got.get((-1, j), 0) for j in range(dims)]
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # centred in integers, rounded once
            v[i, j] = v[j, i] = (n * got[i, j] - sums[i] * sums[j]) / (n * n) if n else 0.0
    values, basis = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: min(k, dims)]
    return Model(n, sums, values[order], basis[:, order], float(np.trace(v)))


def square_sums(z: np.ndarray) -> list[int]:
    """The exact sum of squares of every row."""
    size = max(int(z.max(initial=0)), -int(z.min(initial=0)))
    if size * size * z.shape[1] < 1 << 63:
        return (z * z).sum(axis=1).tolist()
    parts = limbs(z)
    total = np.zeros(len(z), dtype=object)
    for (i, p), (j, q) in itertools.product(enumerate(parts), repeat=2):
        total += np.einsum("rd,rd->r", p, q).astype(object) << BITS * (i + j)
    return total.tolist()


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum of (n * x - sums)^2 of every row."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    near = x - whole  # both lie within 2^62
    size = max(int(near.max(initial=0)), -int(near.min(initial=0)))
    if (size + 1) * n < 1 << 62:
        return square_sums(near * n - np.array([s % n for s in sums], dtype=np.int64))
    return [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def transform(vectors: DataFrame, model: Model, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, deviation decimal(38,0), whitened array<double> of every usable row.

    deviation is null where it has more than 38 digits."""
    n, sums = model.n, model.sums
    dims = len(sums)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([s // n for s in sums], dtype=np.int64) if n else None
        rest = np.array([(s % n) / n for s in sums]) if n else None
        to = model.vectors * model.scales
        for batch in batches:
            x = integers(batch.column(1), dims)
            w = ((x - whole).astype(np.float64) - rest) @ to
            far = [d if d < 10**38 else None for d in deviations(x, n, sums)]
            if all(d is not None and d < 1 << 63 for d in far):
                far = pa.array(far, pa.int64()).cast(pa.decimal128(38, 0))
            else:
                far = pa.array([None if d is None else f"{d}" for d in far]).cast(pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), far, lists], schema=schema)

    good = usable(vectors, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    return good.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n, centred) minus the
    identity, measured over the rows of transform(). Directions without variance don't count."""
    at = [c for c, s in enumerate(model.scales) if s]
    if not at:
        return 0.0
    item = lambda c: F.get("whitened", c)
    means = whitened.agg(*[F.avg(item(c)) for c in at]).first()
    if means[0] is None:
        return 0.0
    centred = {c: item(c) - F.lit(m) for c, m in zip(at, means, strict=True)}
    pairs = list(itertools.combinations_with_replacement(at, 2))
    cov = whitened.agg(*[F.avg(centred[a] * centred[b]) for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(cov, pairs, strict=True))


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """One row per usable input row and component: vec_id, component (from 1, by falling
    eigenvalue), n, deviation long, whitened, explained, identity_error, and deviation_exact
    decimal(38,0). deviation is null where it is beyond a long.

    Rows whose vector is null or holds null or non-finite entries are left out; null ids stay.
    Vectors shorter than the longest go on with zeros. Equal eigenvalues have some orthogonal basis of
    their space, the same for all rows. A direction without variance (a single row, repeated rows)
    gives 0. Repeated rows are fitted and returned each; there are no more components than
    dimensions; an empty table gives no rows; other columns, whatever their names, stay behind."""
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    model = fit(vectors, "embedding", k)
    made = materialize(transform(vectors, model))
    shares = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    rows = made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(identity_error(made, model)).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))
