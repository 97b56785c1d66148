"""Nearest neighbours by inner product over shifted Hilbert orderings.

1. Equal vectors are taken together: of each distinct vector the ``k + 1`` least ids
   are candidates, and the least one asks for all queries that have this vector.
2. Vectors are lifted by one coordinate so that the largest inner product is the
   least distance, projected to ``DIMS`` random orthonormal directions and scaled
   by quantiles fitted on a bounded sample (``SAMPLE`` rows).  Every candidate gets
   a Hilbert key in each of ``ORDERINGS`` orderings, which differ in their
   directions and shift.  Each ordering is range-partitioned and sorted by key, and
   its neighbouring rows are packed into blocks of at most ``block`` rows.
3. The reach of the windows is measured, not guessed: ``PROBES`` askers are scored
   against all rows, and the reach is the number of ranks within which a share of
   ``target`` of their true neighbours lies in one of the orderings, at least
   ``reach``.  It follows from the data alone, by the same rule at every size.
4. An asker's window in an ordering is every block that its own block's reach
   touches.  The rows of its windows in all orderings are scored, merged and ranked
   again by exact scores.  Nothing else answers: what lies in no window is missed.

Vectors with clusters need short windows.  Directions without structure need wide
ones: there the reach is a fixed share of all rows, and the cost that of scoring
the query set against about all rows in blocks.

Scores are double sums over the original components, in their order, so equal
vectors tie exactly; ties go to the smaller vec_id.  Rows with a null vec_id, and
vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of another length than the most common one neither.  A vec_id names
one row: repeated rows count once, as query and as candidate.  With fewer candidates than
``k`` all are returned; an empty table gives an empty result; columns other than
vec_id and embedding play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import Durable, ship, shuffle_partitions, small

DIMS, BITS, ORDERINGS, SAMPLE = 6, 10, 4, 20_000
REACH, BLOCK, PROBES, TARGET, PART_ROWS = 512, 4096, 128, 0.95, 65_536
_FOUND = "asker long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of rows of cells (n, dims), each cell below 2 ** bits; Skilling 2004."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """The fitted orderings."""

    def __init__(self, sample: np.ndarray, most: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        self.most = most
        self.axes = [np.linalg.qr(rng.standard_normal((size, min(DIMS, size))))[0] for _ in range(ORDERINGS)]
        self.scale = []
        for axes in self.axes:
            low, high = np.quantile(self.lift(sample) @ axes, [0.005, 0.995], axis=0)
            wide = np.maximum(high - low, 1e-9)
            self.scale.append((low - wide * rng.random(len(wide)) / 2, wide * 1.5))

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.most**2 - (vectors**2).sum(1)))
        return np.column_stack([vectors, rest])

    def keys(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        low, wide = self.scale[ordering]
        cells = np.clip((self.lift(vectors) @ self.axes[ordering] - low) / wide * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert(cells)


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in the order of the components."""
    total = np.zeros(len(queries))
    for i in range(queries.shape[1]):
        total += queries[:, i] * vectors[:, i]
    return total


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best rows, ties to the smaller id; an id counts once."""
    order = np.lexsort((-score, vec, query))
    q, v = query[order], vec[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])]] if len(order) else order
    order = order[np.lexsort((vec[order], -score[order], query[order]))]
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _batch(asker: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(asker, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["asker", "vec_id", "score"])


def _score(ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, vec: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of each query that reach its bound, by exact scores."""
    rough = queries @ vectors.T
    slack = 1e-9 * (1 + np.sqrt((queries**2).sum(1)) * np.sqrt((vectors**2).sum(1)).max(initial=0.0))
    if vectors.shape[0] > k:
        bounds = np.maximum(bounds, np.partition(rough, -k, axis=1)[:, -k] - slack)
    i, j = np.nonzero(rough >= (bounds - slack)[:, None])
    score = exact(queries[i], vectors[j])
    keep = best(ids[i], vec[j], score, k)
    return _batch(ids[i][keep], vec[j][keep], score[keep])


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components as they are stored (float) or as doubles, of the rows that take part."""
    double = embeddings.schema["embedding"].dataType.simpleString() != "array<float>"
    values = F.col("embedding").cast("array<double>") if double else F.col("embedding")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v")).filter("vec_id is not null and v is not null")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def _candidates(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Of each distinct vector the k + 1 least ids; the least one asks if a query has the vector."""
    distinct = rows.groupBy("vec_id", "h", "g").agg(F.first("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    distinct = distinct.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)  # limited before its shuffle
    asked = wanted.select("h", "g").distinct().withColumn("_asked", F.lit(True))
    return distinct.join(asked.hint("merge"), ["h", "g"], "left").select("vec_id", "h", "g", ((F.col("_rank") == 1) & F.col("_asked").isNotNull()).alias("asks"), "v")


def _keyed(rows: DataFrame, curves: Curves) -> DataFrame:
    """Each row once for each ordering, with its key."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = matrix(part.column("v"))
            for i in range(ORDERINGS if part.num_rows else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, i, np.int32)), pa.array(curves.keys(vectors, i)), part.column("vec_id"), part.column("asks"), part.column("v")], ["ordering", "key", "vec_id", "asks", "v"])

    return rows.select("vec_id", "asks", "v").mapInArrow(batches, f"ordering int, key long, vec_id long, asks boolean, v {rows.schema['v'].dataType.simpleString()}")


def _blocks(size: int):
    """Each ``size`` neighbouring rows of one ordering in a sorted partition as one row."""

    def packed(part: int, at: int, rows: pa.Table) -> pa.RecordBatch:
        values = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        columns = [pa.array([int(rows["ordering"][0].as_py())], pa.int32()), pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([rows.num_rows], pa.int64())]
        columns += [pa.array([x.tobytes()]) for x in (rows["vec_id"].to_numpy(), rows["asks"].to_numpy(), values)]
        return pa.RecordBatch.from_arrays(columns, ["ordering", "part", "at", "n", "ids", "asks", "vectors"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, at, held, rows, ordering = TaskContext.get().partitionId(), 0, [], 0, None
        for part in parts:
            edges = [0, *(np.flatnonzero(np.diff(part.column("ordering").to_numpy())) + 1).tolist(), part.num_rows] if part.num_rows else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = part.column("ordering")[a].as_py()
                if rows and now != ordering:
                    yield packed(number, at, pa.Table.from_batches(held))
                    at, held, rows = at + 1, [], 0
                ordering, held, rows = now, [*held, part.slice(a, b - a)], rows + b - a
                while rows >= size:
                    table = pa.Table.from_batches(held)
                    yield packed(number, at, table.slice(0, size))
                    rest = table.slice(size)
                    at, held, rows = at + 1, [x for x in rest.to_batches() if x.num_rows], rest.num_rows
        if rows:
            yield packed(number, at, pa.Table.from_batches(held))

    return batches


def _unpacked(row: dict, size: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, whether they ask, and vectors of a block."""
    vectors = np.frombuffer(row["vectors"], kind).astype(np.float64).reshape(-1, size)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["asks"], bool), vectors


def _own(k: int, size: int, kind: str):
    """Scores the askers of each block against its rows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                ids, asks, vectors = _unpacked({c: part.column(c)[row].as_py() for c in ("ids", "asks", "vectors")}, size, kind)
                some = np.flatnonzero(asks)
                if len(some):
                    yield _score(ids[some], vectors[some], np.full(len(some), -math.inf), ids, vectors, k)

    return batches


def _askers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ordering, block and id of each asker."""
    for part in parts:
        for row in range(part.num_rows):
            ids = np.frombuffer(part.column("ids")[row].as_py(), np.int64)[np.frombuffer(part.column("asks")[row].as_py(), bool)]
            same = [pa.array(np.full(len(ids), part.column(c)[row].as_py(), t)) for c, t in (("ordering", np.int32), ("block", np.int64))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(ids)], ["ordering", "block", "asker"])


def _windows(k: int, size: int, kind: str):
    """Scores the askers of a chunk against the rows of a block of their window."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                ids, _, vectors = _unpacked({c: part.column(c)[row].as_py() for c in ("ids", "asks", "vectors")}, size, kind)
                chunk = part.column("chunk")[row].values
                asker, bound = chunk.field("asker").to_numpy(), chunk.field("bound").to_numpy()
                yield _score(asker, matrix(chunk.field("v")), bound, ids, vectors, k)

    return batches


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each asker's k best rows with their rank."""
    found = found.groupBy("asker", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _places(blocks: DataFrame) -> DataFrame:
    """Number and first rank of each block in its ordering: a few numbers a block."""
    order = Window.partitionBy("ordering").orderBy("part", "at")
    return blocks.select("ordering", "part", "at", F.row_number().over(order).cast("long").alias("block"), (F.sum("n").over(order) - F.col("n")).alias("first"))


def _needed(vectors: DataFrame, blocks: DataFrame, k: int, target: float, probes: int) -> int:
    """The ranks within which a share of the probes' true neighbours lie in one ordering; at most probes * (k + 1) ids are looked up."""
    asked = vectors.filter("asks").select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).collect()
    if not asked:
        return 0
    ids, queries = np.array([r.vec_id for r in asked], np.int64), np.array([r.v for r in asked], np.float64)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _batch(ids[:0], ids[:0], np.zeros(0))
        for part in parts:
            if part.num_rows:
                new = _score(ids, queries, np.full(len(ids), -math.inf), part.column("vec_id").to_numpy(), matrix(part.column("v")), k + 1)
                both = [np.concatenate([held.column(c).to_numpy(), new.column(c).to_numpy()]) for c in range(3)]
                keep = best(*both, k + 1)
                held = _batch(*(x[keep] for x in both))
        yield held

    true = [(r.asker, r.vec_id) for r in _merged(vectors.select("vec_id", "v").mapInArrow(scored, _FOUND), k + 1).collect() if r.asker != r.vec_id]
    wanted = np.unique(np.array([x for pair in true for x in pair] or [0], np.int64))

    def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                held = np.frombuffer(part.column("ids")[row].as_py(), np.int64)
                at = np.flatnonzero(np.isin(held, wanted))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part.column("ordering")[row].as_py(), np.int32)), pa.array(held[at]), pa.array(at + part.column("first")[row].as_py())], ["ordering", "vec_id", "rank"])

    rank = {(r.ordering, r.vec_id): r.rank for r in blocks.select("ordering", "ids", "first").mapInArrow(looked_up, "ordering int, vec_id long, rank long").collect()}
    away = [min(abs(rank[o, a] - rank[o, b]) for o in range(ORDERINGS)) for a, b in true]
    return int(np.quantile(away, target, method="higher")) if away else 0


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, reach: int = REACH, block: int = BLOCK, target: float = TARGET, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every`` its k nearest rows."""
    spark = embeddings.sparkSession
    ship(spark)
    store = Durable(spark, "ann")
    rows = _valid(embeddings)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).alias("most")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = sizes["size"], sizes["n"]
    rows = rows.filter(F.size("v") == size).select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    kind = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    wanted = store.write(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h", "g").distinct(), "queries")
    vectors = store.write(_candidates(rows, wanted, k), "vectors")
    sample = np.array([r.v for r in rows.sample(min(1.0, 1.2 * SAMPLE / n), seed=1).limit(SAMPLE).collect()] or [r.v for r in rows.limit(100).collect()], np.float64)
    curves = Curves(sample, sizes["most"])
    parts = max(shuffle_partitions(spark), math.ceil(n * ORDERINGS / PART_ROWS))
    ordered = _keyed(vectors, curves).repartitionByRange(parts, "ordering", "key", "vec_id").sortWithinPartitions("ordering", "key", "vec_id")
    shape = "ordering int, part int, at long, n long, ids binary, asks binary, vectors binary"
    blocks = store.write(ordered.select("ordering", "vec_id", "asks", "v").mapInArrow(_blocks(block), shape), "packed")
    blocks = store.write(blocks.join(small(_places(blocks)), ["ordering", "part", "at"]), "blocks")
    reach = max(reach, _needed(vectors, blocks, k, target, probes))

    # What an asker finds in its own blocks bounds what is worth finding elsewhere.
    near = store.write(_merged(blocks.select("ids", "asks", "vectors").mapInArrow(_own(k + 1, size, kind), _FOUND), k + 1), "near")
    bounds = near.filter(F.col("rank") == k + 1).select("asker", F.col("score").alias("bound"))
    asking = vectors.filter("asks").select(F.col("vec_id").alias("asker"), "v").join(bounds, "asker", "left").select("asker", F.coalesce("bound", F.lit(-math.inf)).alias("bound"), "v")
    askers = blocks.select("ordering", "block", "ids", "asks").mapInArrow(_askers, "ordering int, block long, asker long")
    chunks = askers.join(asking.hint("merge"), "asker").groupBy("ordering", "block").agg(F.collect_list(F.struct("asker", "bound", "v")).alias("chunk"))  # a block's askers at most
    order = Window.partitionBy("ordering").orderBy("first")
    touched = blocks.select("ordering", "block", "first")
    touched = touched.select("ordering", "block", F.min("block").over(order.rangeBetween(-(reach + block - 1), 0)).alias("low"), F.max("block").over(order.rangeBetween(0, reach + block - 1)).alias("high"))
    chunks = store.write(chunks.join(touched.hint("merge"), ["ordering", "block"]), "chunks")
    pairs = chunks.select("ordering", F.explode(F.filter(F.sequence("low", "high"), lambda b: b != F.col("block"))).alias("block"), "chunk")
    scored = pairs.join(blocks.select("ordering", "block", "ids", "asks", "vectors").hint("merge"), ["ordering", "block"]).select("ids", "asks", "vectors", "chunk")
    found = scored.mapInArrow(_windows(k + 1, size, kind), _FOUND).unionByName(near.select("asker", "vec_id", "score"))
    lists = _merged(found, k + 1).groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    answers = vectors.filter("asks").select(F.col("vec_id").alias("asker"), "h", "g").join(lists.hint("merge"), "asker").select("h", "g", "found")
    answers = store.write(answers, "answers")
    own = wanted.join(answers.hint("merge"), ["h", "g"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
