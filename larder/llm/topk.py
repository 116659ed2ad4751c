"""Exact top-k search by a pivot-distance index.

Components become the integers floor(1024 x); the score is the integer inner product.  A further coordinate, sqrt(M^2 - |x|^2) with M the largest length
of all vectors and 0 for queries, turns the order by inner product into the order by distance:
|q - x|^2 = |q|^2 + M^2 - 2 q.x.  So the triangle inequality holds for what is searched.

Index: every vector is keyed by its nearest pivot and its distance to it.  The distances of a pivot's vectors are cut at their quantiles into
annuli, which are packed into blocks.  The directory of annuli has at most PIVOTS * ANNULI rows, whatever the table's size.

Search: for a query q, a pivot p and an annulus [low, high] no vector in it is nearer than the gap between |q - p| and the annulus.  Blocks
are visited in the order of their gaps, some at first, then four times as many in each round.  The k-th best score so far gives a radius, and
a query stops when the next gap is larger.  Nothing is left out unless that bound says so, so results are exact; pivots (from a bounded
sample) only decide how soon it stops.

Equal vectors are one entry with their least ids: of more copies than k + 1 the further ones can't be among the k best of any query.  Queries with equal vectors
are searched for once, for k + 1 rows, of which each then leaves out its own.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as queries; vectors of other lengths than the query's aren't compared with it, and
each length has an index of its own; ties go to the smaller vec_id, a null one last; rows with a null id are no queries; repeated rows are rows each, of which a query leaves out one; vectors of any
length are compared whole; scores beyond 64 bits are an error; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, col, scratch, slices, written

#: Pivots at most, annuli of a pivot at most, vectors and bytes of a block, vectors and bytes of the sample that pivots are made from.
PIVOTS, ANNULI, BLOCK, BLOCK_BYTES, SAMPLE, SAMPLE_BYTES = 256, 256, 2048, 2 << 20, 4096, 8 << 20
#: Blocks visited in the first round, how many times as many in each further one, queries of a tile.
FIRST, MORE, TILE = 4, 4, 64
SCALE = 1024
SEED = 5
#: Distances are rounded: a gap must be larger than the radius by this part of the largest length.
SLACK = 1e-6


def pivots_of(sample: np.ndarray, many: int) -> np.ndarray:
    """Centres of a few rounds of k-means, begun with vectors far from each other."""
    rng = np.random.default_rng(SEED)
    many = min(many, len(sample))
    far = ((sample - sample[rng.integers(len(sample))]) ** 2).sum(axis=1)
    chosen = []
    for _ in range(many):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centres = sample[chosen].copy()
    for _ in range(5):
        near = distances(sample, centres).argmin(axis=1)
        for k in np.unique(near):
            centres[k] = sample[near == k].mean(axis=0)
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0.0))


def products(q: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products of integer rows of absolute components up to ``most``."""
    bound = q.shape[1] * most * most
    if bound < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def search(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``df`` for each row of ``queries`` (a part of the rows of ``df``), its own left out."""
    with scratch("found"), arrow_rows(df.sparkSession, 256):
        whole = lambda t: t.select(col(key).cast("long").alias("id"), col(vector).cast("array<double>").alias("v")).where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)))
        inner = lambda t: whole(t).select("id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"), F.size("v").alias("dim"))
        rows, asked = inner(df), inner(queries).where("id is not null")
        size = rows.select("dim", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("square"), F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)).alias("most"))
        lengths = size.groupBy("dim").agg(F.max("square"), F.max("most"), F.count("*")).collect()  # a table of vectors has few lengths
        parts = [_of_length(rows.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), k, dim, square, most, n) for dim, square, most, n in sorted(lengths)]
        if not parts:
            return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return written(out, "found")


def _of_length(rows: DataFrame, asked: DataFrame, k: int, dim: int, square: float, most: int, n: int) -> DataFrame:
    if dim * most * most >= 1 << 63:
        raise ValueError(f"scores of components up to {most} don't fit 64 bits")
    kind = np.dtype("i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8")
    length = math.sqrt(square)
    slack = SLACK * (length + 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, kind).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "raw"])

    # of each vector the k + 1 least ids; tasks keep no more of one, before the shuffle
    least = Window.partitionBy("raw").orderBy(F.col("id").asc_nulls_last())
    entries = rows.select("id", "v").mapInArrow(packed, "id long, raw binary").withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"])
    classes = written(entries.groupBy("raw").agg(ids.alias("ids")).withColumn("entry", F.monotonically_increasing_id()), "entries")
    own = written(asked.select("id", "v").mapInArrow(packed, "id long, raw binary"), "asked")
    want = written(own.select("raw").distinct().join(classes.select("raw", "entry"), "raw"), "wanted")
    count = classes.count()

    def lifted(raw: list[bytes], query: bool = False) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim).astype(np.float64)
        return np.hstack([x, np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(square - (x * x).sum(axis=1, keepdims=True), 0))])

    room = max(1, SAMPLE_BYTES // (8 * (dim + 1)))
    sample = [bytes(r[0]) for r in classes.select("raw").sample(min(1.0, min(SAMPLE, room) / count), SEED).limit(min(SAMPLE, room)).collect()] or [bytes(classes.select("raw").first()[0])]
    pivots = pivots_of(lifted(sample), max(1, min(PIVOTS, room, math.isqrt(count) // 2)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            far = distances(lifted(batch.column(0).to_pylist()), pivots) if batch.num_rows else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1), pa.int32()), pa.array(far.min(axis=1), pa.float64())], names=["raw", "ids", "entry", "pivot", "far"])

    keyed = written(classes.mapInArrow(near, "raw binary, ids array<long>, entry long, pivot int, far double"), "keyed")
    bounds = keyed.groupBy("pivot").agg(F.percentile_approx("far", [j / ANNULI for j in range(1, ANNULI)], 10_000).alias("at"), F.count("*").alias("n"))
    held = max(1, min(BLOCK, BLOCK_BYTES // (kind.itemsize * dim + 1)))
    # as many annuli as blocks are needed, ANNULI at most
    some = F.filter("at", lambda x, i: (i + 1) % F.greatest(F.lit(1), F.floor(F.lit(ANNULI) * held / F.col("n"))) == 0)
    placed = keyed.join(F.broadcast(bounds.select("pivot", F.array_distinct(some).alias("at"))), "pivot")  # PIVOTS rows
    placed = placed.withColumn("ring", F.size(F.filter("at", lambda x: x < F.col("far")))).drop("at")
    rings = placed.groupBy("pivot", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
    rings = written(rings.withColumn("blocks", F.ceil(F.col("n") / held).cast("int")), "rings")
    directory = rings.orderBy("pivot", "ring").collect()  # PIVOTS * ANNULI rows at most
    ring_pivot, low, high, blocks = (np.array([r[c] for r in directory], t) for c, t in (("pivot", np.int64), ("low", float), ("high", float), ("blocks", np.int64)))
    first_block = np.cumsum(blocks) - blocks
    ring_of = np.repeat(np.arange(len(blocks)), blocks)

    numbers = rings.select("pivot", "ring", "blocks", (F.sum("blocks").over(Window.orderBy("pivot", "ring")) - F.col("blocks")).alias("first"))
    dealt = placed.join(F.broadcast(numbers), ["pivot", "ring"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("entry"), F.col("blocks")))

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"].slice(0, 1), "entries": pa.array([table["entry"].to_pylist()]), "ids": pa.array([table["ids"].to_pylist()]), "rows": pa.array([b"".join(table["raw"].to_pylist())], pa.binary())})

    index = written(dealt.select("block", "entry", "ids", "raw").groupBy("block").applyInArrow(pack, "block long, entries array<long>, ids array<array<long>>, rows binary"), "index")

    def tiles(seen: int, upto: int):
        """For some queries at a time: their vectors, gathered for each block that they visit next."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, TILE):
                raw, entry, last = batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()
                q = lifted(raw, query=True)
                far = distances(q, pivots)[:, ring_pivot]
                gap = np.maximum(np.maximum(low - far, far - high), 0.0)
                norm = (q * q).sum(axis=1)
                radius = np.array([np.inf if s is None else math.sqrt(max(0.0, x + square - 2.0 * s)) for s, x in zip(last, norm, strict=True)])
                visits: dict[int, list[int]] = {}
                for i in range(len(raw)):
                    order = np.argsort(gap[i], kind="stable")
                    # a query's blocks in the order of their annuli's gaps; those before ``seen`` are done
                    ends = np.cumsum(blocks[order])
                    for at in range(int(np.searchsorted(ends, seen, "right")), len(order)):
                        ring = order[at]
                        begin = int(ends[at] - blocks[ring])
                        if begin >= upto or gap[i, ring] > radius[i] + slack:
                            break
                        for b in range(max(seen - begin, 0), int(min(upto - begin, blocks[ring]))):
                            visits.setdefault(int(first_block[ring]) + b, []).append(i)
                if visits:
                    names, kinds = ["block", "asking", "vectors"], [pa.int64(), pa.list_(pa.int64()), pa.binary()]
                    told = [list(visits), [[entry[i] for i in v] for v in visits.values()], [b"".join(raw[i] for i in v) for v in visits.values()]]
                    for s in range(0, len(visits), 256):
                        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 256], t) for c, t in zip(told, kinds, strict=True)], names=names)

        return visit

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["asking", "score", "id", "entry"], [pa.int64()] * 4
        for batch in slices(batches, 1):
            x = batch.to_pylist()[0]
            own, q = (np.frombuffer(x[c], kind).reshape(-1, dim) if dim else np.zeros((m, 0), kind) for c, m in (("rows", len(x["entries"])), ("vectors", len(x["asking"]))))
            got = products(q, own, most)
            first = np.array([i[0] if i[0] is not None else 1 << 62 for i in x["ids"]])
            out = []
            for i, asking in enumerate(x["asking"]):
                s = got[i]
                best = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]) if len(s) > k + 1 else np.arange(len(s))
                best = best[np.lexsort((first[best], -s[best]))[: k + 1]]
                rows = sorted(((-int(s[j]), c is None, c or 0, c, x["entries"][j]) for j in best.tolist() for c in x["ids"][j]), key=lambda r: r[:3])
                out += [(asking, -r[0], r[3], r[4]) for r in rows[: k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    ranked = Window.partitionBy("asking").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), F.asc("entry"))
    best, seen, upto = None, 0, FIRST
    while True:
        state = want.select("entry", "raw")
        if best is not None:
            state = state.join(best.where(F.col("nth") == k + 1).select(F.col("asking").alias("entry"), F.col("score").alias("last")), "entry", "left")
        else:
            state = state.withColumn("last", F.lit(None).cast("long"))
        visits = written(state.select("entry", "raw", "last").mapInArrow(tiles(seen, upto), "block long, asking array<long>, vectors binary"), "visits")
        if visits.isEmpty():
            break
        more = visits.join(index, "block").mapInArrow(score, "asking long, score long, id long, entry long")
        both = more if best is None else more.unionByName(best.drop("nth"))
        best = written(both.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1), "best")
        if upto >= len(ring_of):
            break
        seen, upto = upto, upto * (1 + MORE)

    hits = F.transform(F.array_sort(F.collect_list(F.struct("nth", "score", "id", "entry"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"), x["entry"].alias("entry")))
    if best is None:  # no queries of this length
        best = want.select(F.col("entry").alias("asking"), F.lit(0).cast("long").alias("score"), F.lit(None).cast("long").alias("id"), "entry", F.lit(1).alias("nth"))
    told = best.groupBy("asking").agg(hits.alias("hits")).join(want.select(F.col("entry").alias("asking"), "raw"), "asking")
    told = own.join(told, "raw")
    # its own row is one of its entry's with its id
    mine = F.array_position(F.transform("hits", lambda x: F.coalesce((x["id"] == F.col("id")) & (x["entry"] == F.col("asking")), F.lit(False))), True)
    left = told.withColumn("mine", mine).select("id", F.slice(F.filter("hits", lambda x, i: i + 1 != F.col("mine")), 1, k).alias("hits"))
    flat = left.select("id", F.posexplode("hits").alias("at", "hit"))
    return flat.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest(df: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    return search(df, df.where(F.col("vec_id") % every == 0), k)


SQL = f"""
with rows as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v, row_number() over () as nth from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from rows as q join rows as c on q.nth <> c.nth and len(q.v) = len(c.v) where q.vec_id % 100 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from pairs
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""
