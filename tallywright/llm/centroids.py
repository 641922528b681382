"""Operator 12, centroid clustering: exact integer k-means, filtered through ball trees.

Vectors are packed once into blocks of at most BLOCK rows, each with a metric tree of its own: a ball has its vectors' range in tree order,
its centre, radius, count, sum and sum of squares. In a round a ball keeps only the centroids that by the triangle inequality may be
nearest to one of its vectors (d(centre, c) - radius <= d(centre, nearest) + radius). A ball for which one is left goes to it whole, through its count and
sum; otherwise its halves are searched, and at a leaf the distances are taken exactly. A round sends 16 sums a task to the driver, whatever the input.

All arithmetic that decides a result is in integers: products run in doubles only where they stay below 2**53. The bounds have a
slack for rounding, so that a ball is never given away that an exact comparison might split; equal centroids count as the first of them.

Edge cases: a vector of another length than 64, or with a null or non-finite component, isn't kept; neither is one with a component of
LARGEST or more, whose squared distances a long can't hold. A null vec_id hashes as an empty text. Rows of one vec_id are clustered as
separate vectors; of those that tie as a start the smaller vector comes first. Fewer than 16 vectors give fewer centroids, none no rows. Other
columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, scratch

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
BLOCK = 4096
LEAF = 32
LARGEST = 2**27
#: Up to this size of components, sums of 64 products and squares are exact in doubles.
_EXACT = 2**22


def kept(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (whole components) of the vectors that take part."""
    x = F.col("embedding")
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < LARGEST / SCALE))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("int"))
    return embeddings.select("vec_id", "embedding").where((F.size(x) == DIMENSIONS) & fit).select("vec_id", whole.alias("v"))


def starts(vectors: DataFrame) -> np.ndarray:
    """The first centroids, in order of the hash of SEED and vec_id."""
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(CENTROIDS).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIMENSIONS)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


class Balls:
    """A block's metric tree as arrays; node i's vectors are order[lo[i]:hi[i]], its halves left[i] and left[i] + 1 (0: a leaf)."""

    FIELDS = ("lo", "hi", "left", "radius", "centre", "sum", "square")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @staticmethod
    def built(x: np.ndarray) -> tuple[np.ndarray, Balls]:
        """The vectors' order in the tree, and the tree. A ball is halved between its vectors nearer to either of two far ones."""
        order = np.arange(len(x))
        spans, lefts, at = [(0, len(x))], [], 0
        while at < len(spans):
            lo, hi = spans[at]
            at += 1
            if hi - lo <= LEAF:
                lefts.append(0)
                continue
            own = order[lo:hi]
            y = x[own].astype(np.float64)
            a = y[((y - y.mean(0)) ** 2).sum(1).argmax()]
            b = y[((y - a) ** 2).sum(1).argmax()]
            side = y @ (b - a)
            if side.min() == side.max():  # equal vectors: one ball of no size
                lefts.append(0)
                continue
            middle = (hi - lo) // 2
            order[lo:hi] = own[np.argpartition(side, middle)]
            lefts.append(len(spans))
            spans += [(lo, lo + middle), (lo + middle, hi)]
        z = x[order]
        lo, hi = np.array(spans, np.int32).T
        totals, squares = np.zeros((len(z) + 1, x.shape[1]), np.int64), np.zeros(len(z) + 1, np.int64)
        np.cumsum(z, 0, out=totals[1:])
        np.cumsum((z * z).sum(1), out=squares[1:])  # modulo 2**64: only differences of it are used, which fit
        sums = totals[hi] - totals[lo]
        centre = sums / (hi - lo)[:, None]
        radius = np.array([np.sqrt(((z[i:j] - m) ** 2).sum(1).max()) for i, j, m in zip(lo, hi, centre, strict=True)])
        return order, Balls(lo=lo, hi=hi, left=np.array(lefts, np.int32), radius=radius, centre=centre, sum=sums, square=squares[hi] - squares[lo])

    def pack(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k)).tobytes() for k in self.FIELDS}

    @staticmethod
    def unpack(row: dict) -> Balls:
        kinds = {"lo": np.int32, "hi": np.int32, "left": np.int32, "radius": np.float64, "centre": np.float64, "sum": np.int64, "square": np.int64}
        got = {k: np.frombuffer(row[k], t) for k, t in kinds.items()}
        return Balls(**got | {k: got[k].reshape(-1, DIMENSIONS) for k in ("centre", "sum")})

    def filtered(self, x: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, int | None, np.ndarray | None, np.ndarray | None]]:
        """(node, -1, centroid, None, None) of balls that go to one centroid whole, and (node, 0, None, centroids, distances) of searched leaves.
        x: the block's vectors in tree order."""
        first = np.unique(centroids, axis=0, return_index=True)[1]
        c = centroids.astype(np.float64)
        todo = [(0, np.sort(first))]
        while todo:
            node, near = todo.pop()
            d = np.sqrt(((c[near] - self.centre[node]) ** 2).sum(1))
            slack = 1e-9 * (1 + d.max() + self.radius[node])
            near = near[d <= d.min() + 2 * self.radius[node] + slack]
            if len(near) == 1:
                yield node, -1, int(near[0]), None, None
            elif self.left[node]:
                todo += [(self.left[node] + 1, near), (self.left[node], near)]
            else:
                yield node, 0, None, near, _distances(x[self.lo[node] : self.hi[node]], centroids[near])


_BLOCKS = "ids array<{}>, vectors binary, " + ", ".join(f"{k} binary" for k in Balls.FIELDS)


def blocks(vectors: DataFrame) -> DataFrame:
    """One row a block: ids and vectors in tree order, and the tree's arrays."""
    schema = _BLOCKS.format(dict(vectors.dtypes)["vec_id"])

    def made(ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held).astype(np.int64)
        order, tree = Balls.built(x)
        ids = pa.concat_arrays(ids).take(pa.array(order))
        row = {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "vectors": [x[order].astype(np.int32).tobytes()]}
        return pa.RecordBatch.from_pydict(row | {k: [v] for k, v in tree.pack().items()})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, BLOCK - n)
                ids.append(part.column("vec_id"))
                held.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS))
                at, n = at + len(part), n + len(part)
                if n == BLOCK:
                    yield made(ids, held)
                    ids, held, n = [], [], 0
        if n:
            yield made(ids, held)

    return mapped(vectors, build, schema)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, Balls]]:
    for batch in batches:
        for i in range(len(batch)):
            row = {k: batch.column(k)[i].as_py() for k in Balls.FIELDS}
            x = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.int32).reshape(-1, DIMENSIONS).astype(np.int64)
            yield batch.column("ids")[i].values, x, Balls.unpack(row)


def sums(packed: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int], int]]:
    """Per centroid, in order: how many vectors it is nearest to, their sum by components, and their squared distances' sum."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64), np.zeros(k, np.int64)
        for _, x, tree in _opened(batches):
            for node, _, whole, near, d in tree.filtered(x, centroids):
                lo, hi = tree.lo[node], tree.hi[node]
                if whole is not None:
                    c = centroids[whole]
                    count[whole] += hi - lo
                    total[whole] += tree.sum[node]
                    # sum of (x - c)**2, modulo 2**64: the whole fits a long even where its parts don't
                    square[whole] += tree.square[node] - 2 * (c * tree.sum[node]).sum() + (hi - lo) * (c * c).sum()
                    continue
                best = near[d.argmin(1)]
                np.add.at(count, best, 1)
                np.add.at(total, best, x[lo:hi])
                np.add.at(square, best, d.min(1))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"k": pa.array(used, pa.int32()), "n": count[used], "total": pa.array(total[used].tolist(), pa.list_(pa.int64())), "square": square[used]})

    got = mapped(packed, run, "k int, n long, total array<long>, square long")
    added = got.groupBy("k").agg(F.sum("n"), F.sum("square"), *[F.sum(F.col("total")[i]) for i in range(DIMENSIONS)])
    out = [(0, [0] * DIMENSIONS, 0)] * k
    for row in added.collect():  # one row a centroid
        out[row[0]] = (row[1], list(row[3:]), row[2])
    return out


def assigned(packed: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, tree in _opened(batches):
            cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            for node, _, whole, near, d in tree.filtered(x, centroids):
                lo, hi = tree.lo[node], tree.hi[node]
                if whole is not None:
                    cluster[lo:hi], distance[lo:hi] = whole, _distances(x[lo:hi], centroids[whole : whole + 1])[:, 0]
                else:
                    cluster[lo:hi], distance[lo:hi] = near[d.argmin(1)], d.min(1)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": cluster, "distance": distance})

    return mapped(packed, run, f"vec_id {id_type}, cluster int, distance long")


def clusters(embeddings: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    vectors = kept(embeddings)
    id_type = dict(vectors.dtypes)["vec_id"]
    centroids = starts(vectors)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    with scratch(spark) as keep:
        packed = cut(blocks(vectors))
        for _ in range(ROUNDS):
            found = sums(packed, centroids)
            centroids = np.array([[s // n for s in total] if n else old.tolist() for old, (n, total, _) in zip(centroids, found, strict=True)], np.int64)
        spread = [square for _, _, square in sums(packed, centroids)]
        digests = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
        about = spark.createDataFrame([(i, s, sum(spread), d) for i, (s, d) in enumerate(zip(spread, digests, strict=True))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return keep(assigned(packed, centroids, id_type).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), packed)


def _rounds() -> str:
    """CTEs c0.. (centroids k, v) and a0.. (vectors with their nearest)."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(
            f"a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS best FROM "
            f"(SELECT x.row, x.vec_id, x.v, c.k, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM numbered x CROSS JOIN c{i} c) GROUP BY row)"
        )
        if i < ROUNDS:
            out.append(
                f"m{i} AS (SELECT best.k AS k, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM a{i}),\n"
                f"s{i} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM m{i} GROUP BY 1, 2),\n"
                f"f{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY k),\n"
                f"c{i + 1} AS (SELECT c.k, coalesce(f.v, c.v) AS v FROM c{i} c LEFT JOIN f{i} f ON f.k = c.k)"
            )
    return ",\n".join(out)


_FIT = f"len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) < {LARGEST // SCALE})) = {DIMENSIONS}"
ORACLE_SQL = f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FIT}),
numbered AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS row, vec_id, v FROM kept),
c0 AS (SELECT row AS k, v FROM numbered WHERE row < {CENTROIDS}),
{_rounds()},
digests AS (SELECT k, sha256(array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ',')) AS h FROM c{ROUNDS})
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, g.h AS centroid_sha256
FROM a{ROUNDS} JOIN digests g ON g.k = best.k"""
