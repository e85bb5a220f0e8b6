"""Nearest-neighbour retrieval over a reference index, taxa ranking and novelty flags.

Exact search is a stated query set against all rows. Blocks of queries meet pieces of
the index in matrix products, and only the k best of each go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import cosine_distance, euclidean, similarity
from ..session import settled
from .stats import wasserstein

K = 8
#: Query rows that one broadcast block holds; 4,000 rows of 64 dimensions are 2 MB.
QUERY_BLOCK = 4000
#: Pivots that every task holds; 2,048 of 64 dimensions are 1 MB.
MOST_CELLS = 2048
#: Queries up to this many rows are broadcast: with 64 dimensions 10 MB.
BROADCAST_ROWS = 20_000
#: Rows of a block in nearest_rows(): with 64 dimensions 32 MB. Below that many rows for each, an index has as many pieces.
GRID_ROWS, PIECES = 1 << 16, 16
#: Blocks of all rows against all, each row shuffled once to each; more only beyond that many rows a block, with 64 dimensions 40 MB.
ALL_BLOCKS, ALL_ROWS = 8, 80_000
#: Components of differences that a step of a task holds at once, 16 MB.
PAIRS = 1 << 21
#: Queries and rows whose products a step of a task holds at once, 4 MB.
ASKED, SOME = 512, 2048


def small(rows: DataFrame) -> bool:
    """Whether rows may be broadcast; reads no more than one row beyond the bound."""
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def against(index: DataFrame, queries: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Every index row beside every query (query_id, qz): the stated query set against all rows.

    A few queries are broadcast. More go out in blocks: each index row meets each
    block, and the rows of a block are shuffled to it.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("z").alias("qz"))
    other = F.col("id") != F.col("query_id") if exclude_self else F.lit(True)
    if small(queries):
        return index.join(F.broadcast(q), other)
    blocks = max(2, -(-queries.count() // QUERY_BLOCK))
    q = q.withColumn("_b", F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)"))
    # Index rows are salted, so that a block's pairs are spread over tasks.
    salt = max(1, -(-index.count() // QUERY_BLOCK))
    x = index.withColumn("_s", F.expr(f"cast(pmod(xxhash64(id), {salt}) as int)")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return x.join(q.hint("shuffle_hash"), ["_b", "_s"]).where(other).drop("_b", "_s")


def knn(queries: DataFrame, index: DataFrame, k: int = K, metric: str = "euclidean", exclude_self: bool = True) -> DataFrame:
    """The k nearest index rows (id, z) of each query (id, z): query_id, rank, id, dist, similarity.

    Ties go to the smaller id. Rows with the query's id are left out if exclude_self.
    """
    pairs = nearest_rows(queries, index, k, metric, exclude_self)
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "dist", similarity(F.col("dist")).alias("similarity"))


def nearest_rows(queries: DataFrame, index: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True, within: str | None = None) -> DataFrame:
    """(query_id, id, dist) of index rows among which are the k nearest of each query.

    Blocks of queries meet pieces of the index in matrix products, and of each only the k best go on. The numbers of
    both do not grow before a block has GRID_ROWS rows, so what is shuffled grows with the rows, not with the pairs.
    within: a column of the index; each of its values gives its own k nearest. Vectors that are null or hold
    a null or non-finite component take no part.
    """
    vector = F.col("z").cast("array<double>").alias("z")
    q = queries.select(F.col("id").alias("query_id"), vector).where("query_id is not null and z is not null")
    x = index.select("id", vector, *([within] if within else [])).where("id is not null and z is not null")
    blocks, pieces = _grid(q.count(), x.count())
    place = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q, x = q.withColumn("_b", place("query_id", blocks)).withColumn("_p", every(pieces)), x.withColumn("_p", place("id", pieces)).withColumn("_b", every(blocks))
    extra = f", {within} {index.schema[within].dataType.simpleString()}" if within else ""

    def part(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": a["query_id"][:0], "id": b["id"][:0], "dist": np.empty(0)} | ({within: b[within][:0]} if within else {}))]
        if len(a) and len(b):
            z, ids = _stacked(a.rename(columns={"query_id": "id"}))
            for value, rows in b.groupby(within, dropna=False, sort=False) if within else [(None, b)]:
                got = _best(k, *_stacked(rows), z, ids, metric, exclude_self)
                found.append(got.assign(**{within: value}) if within else got)
        found = [f for f in found if len(f)] or found[:1]
        return pd.concat(found, ignore_index=True)

    return q.groupBy("_b", "_p").cogroup(x.groupBy("_b", "_p")).applyInPandas(part, f"query_id {_id_kind(queries)}, id {_id_kind(index)}, dist double{extra}")


def _grid(asked: int, rows: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of pieces of the index. Every query is shuffled to all pieces, so many blocks, which keep all tasks busy, get no more pieces than the rows need."""
    blocks = max(1, -(-asked // GRID_ROWS))
    return blocks, max(min(PIECES, -(-rows // 1000), -(-2 * PIECES // blocks)), -(-rows // GRID_ROWS), 1)


def _nearest_others(rows: DataFrame, total: int, k: int, metric: str) -> DataFrame:
    """(query_id, id, dist) of rows among which are the k nearest others of each of total rows (id, z).

    What nearest_rows() does for a table against itself, at half of its copies: a task holds two blocks and
    answers the rows of both, so a row is shuffled to each block once and not as a query and an index row.
    The number of blocks does not grow before one has ALL_ROWS rows.
    """
    blocks, kind = max(ALL_BLOCKS, -(-total // ALL_ROWS)), _id_kind(rows)
    x = rows.select("id", "z", F.expr(f"cast(pmod(xxhash64(id), {blocks}) as int)").alias("_b"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_pair", F.least("_b", "_o") * blocks + F.greatest("_b", "_o"))

    def part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, other = divmod(key[0], blocks)
        left, right = (pdf[pdf["_b"] == b] for b in (one, other))
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pdf["id"][:0], "id": pdf["id"][:0], "dist": np.empty(0)})
        left, right = _stacked(left), _stacked(right)
        if one == other:
            return _best(k, *left, *left, metric)
        # Rows of equal ids lie in one block, so no pair of these is a row and itself.
        return pd.concat([_best(k, *left, *right, metric, False), _best(k, *right, *left, metric, False)], ignore_index=True)

    # So many partitions that few pairs of blocks share one.
    dealt = x.select("id", "z", "_b", "_pair").repartition(4 * blocks * (blocks + 1) // 2, "_pair")
    return dealt.groupBy("_pair").applyInPandas(part, f"query_id {kind}, id {kind}, dist double")


#: Rows that a query takes beyond what it needs, so that repeated ids can leave; with more repeats, pairs are summed up by id instead.
MOST_FETCHED = 1_000


def knn_distinct(queries: DataFrame, index: DataFrame, k: int = K, metric: str = "euclidean", exclude: DataFrame | None = None, exclude_self: bool = True) -> DataFrame:
    """knn() with an exclusion set, each id once: query_id, rank, id, dist, similarity.

    An id may stand on many index rows; the nearest of them counts. exclude has the ids that are no
    answer: a column id, for all queries, or query_id and id, for one; null ids exclude nothing.
    Of k ids of at most m rows each, the k * m nearest rows hold all, and with e ids left out for a query the (k + e) * m
    nearest do, so so many are taken before repeats leave. All ids get their rank: none is lost to a repeat.
    """
    dist = {"euclidean": euclidean, "cosine": cosine_distance}[metric]
    rows = index.select("id", "z")
    own = exclude is not None and "query_id" in exclude.columns
    if exclude is not None and not own:
        rows = rows.join(exclude.select("id").where("id is not null").distinct(), "id", "left_anti")
    most = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    hidden = exclude.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 if own else 0
    wanted = (k + hidden) * most
    if wanted <= MOST_FETCHED:
        pairs = nearest_rows(queries, rows, wanted, metric, exclude_self)
    else:
        pairs = against(rows, queries, exclude_self).select("query_id", "id", dist(F.col("qz"), F.col("z")).alias("dist"))
    if own:
        pairs = pairs.join(exclude.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    once = pairs.groupBy("query_id", "id").agg(F.min("dist").alias("dist"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "dist", similarity(F.col("dist")).alias("similarity"))


def _id_kind(index: DataFrame) -> str:
    return index.schema["id"].dataType.simpleString()


def _best(k: int, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, metric: str, exclude_self: bool = True) -> pd.DataFrame:
    """Exact best k: candidates by products of tiles in single precision with slack for its rounding, then distances by differences in double precision.

    Products give a lower bound of each squared distance, and the m nearest seen so far an upper bound of the m-th, which later tiles must beat.
    """
    whole = np.isfinite(x).all(1), np.isfinite(q).all(1)
    x, ids, q, qid = x[whole[0]], ids[whole[0]], q[whole[1]], qid[whole[1]]
    if metric == "cosine":
        x, q = (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12) for a in (x, q))
    found: list[tuple] = []
    if k > 0 and len(x) and len(q):
        # Rows with the query's own id may be among the nearest.
        m = k + (int(np.unique(ids, return_counts=True)[1].max()) if exclude_self else 0)
        x, ids = _few_copies(x, ids, m)
        m = min(m, len(x))
        left, right, spare = _bounding(x, q)
        for at in range(0, len(q), ASKED):
            part = slice(at, min(at + ASKED, len(q)))
            i, j = _candidates(m, left[part], right, *(s[r] for s, r in zip(spare, (part, slice(None)), strict=True)))
            i += at
            if exclude_self:
                other = ids[j] != qid[i]
                i, j = i[other], j[other]
            d = np.concatenate([((x[j[c : c + step]] - q[i[c : c + step]]) ** 2).sum(1) for step in [max(1, PAIRS // x.shape[1])] for c in range(0, len(j), step)] or [np.empty(0)])
            d = d / 2 if metric == "cosine" else np.sqrt(d)
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            best = _nth(i) < k
            found.append((qid[i[best]], ids[j[best]], d[best]))
    cols = [np.concatenate(c) for c in zip(*found, strict=True)] or [qid[:0], ids[:0], np.empty(0)]
    return pd.DataFrame(dict(zip(("query_id", "id", "dist"), cols, strict=True)))


def _nth(i: np.ndarray) -> np.ndarray:
    """How many of the same number stand before each of sorted numbers."""
    begins = np.flatnonzero(np.diff(i, prepend=-1))
    return np.arange(len(i)) - np.repeat(begins, np.diff(begins, append=len(i)))


def _few_copies(x: np.ndarray, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows without copies of a vector beyond its m smallest ids: they are equally near, so no other is among the m nearest."""
    same = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    group, n = np.unique(same, return_inverse=True, return_counts=True)[1:]
    if n.max() <= m:
        return x, ids
    order = np.lexsort((ids, group))
    kept = order[_nth(group[order]) < m]
    return x[kept], ids[kept]


def _bounding(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Matrices in single precision whose product is at most the squared distance of each q and x, up to a common scale, and what of q and x has to be added so that it is at least that."""
    # By a power of two, so that only differences from the centre are rounded; the centre is not drawn to rows far out.
    size = 2.0 ** np.frexp(max(np.abs(x).max(), np.abs(q).max(), 1e-130))[1]
    centre = np.median(x[:1000], axis=0) / size
    x, q = x / size - centre, q / size - centre
    scale = max(np.sqrt(max((x**2).sum(1).max(), (q**2).sum(1).max())), 1e-135 / size)
    # Where squares in double precision go over, nothing is left out.
    x, q = (((a / scale) if size < 2.0**500 else 0 * a).astype(np.float32) for a in (x, q))
    xx, qq = ((a.astype(float) ** 2).sum(1) for a in (x, q))
    # Rounding moves a product of d + 2 terms by (d + 2) / 2^24 of (|x| + |q|)^2 <= 2 (|x|^2 + |q|^2) at most, rounding x and q by 4 / 2^24 of it; underflow by less than 1e-30, also that of the distances.
    slack = 2 * (x.shape[1] + 16) / 2**24
    one = lambda a: np.ones((len(a), 1), np.float32)
    lower = lambda aa: (aa * (1 - slack) - 1e-30).astype(np.float32)[:, None]
    left, right = np.hstack([-2 * q, lower(qq), one(q)]), np.hstack([x, one(x), lower(xx)])
    return left, np.ascontiguousarray(right.T), tuple((2 * slack * aa + 4e-30).astype(np.float32) for aa in (qq, xx))


def _set(flags: np.ndarray) -> np.ndarray:
    """Where flags are set, which few are: eight are looked at together."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    words = np.flatnonzero(flags.view(np.uint64) != 0)
    word, bit = np.nonzero(flags.reshape(-1, 8)[words])
    return words[word] * 8 + bit


def _candidates(m: int, left: np.ndarray, right: np.ndarray, own: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of left, columns of right) among which are the m nearest of each row, by rows."""
    limit, (i, j, d) = np.full(len(left), np.inf, np.float32), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    held = 0
    for at in range(0, right.shape[1], SOME):
        low = left @ right[:, at : at + SOME]
        if at == 0 and m <= low.shape[1]:
            # Any m rows bound the m-th nearest from above.
            some = np.argpartition(low[:, : max(m, SOME // 4)], m - 1, axis=1)[:, :m]
            limit = (np.take_along_axis(low, some, 1) + spare[some]).max(1) + own
        new = _set((low <= limit[:, None]).ravel())
        row, col = np.divmod(new, low.shape[1])
        i, j, d = np.concatenate([i, row]), np.concatenate([j, col + at]), np.concatenate([d, low.ravel()[new]])
        if len(i) > 2 * held:
            order = np.lexsort((d, i))
            i, j, d = i[order], j[order], d[order]
            nth = _nth(i)
            # Rows with m candidates or more, each row's m nearest at once.
            first = np.flatnonzero(nth < m)
            enough = np.bincount(i[first], minlength=len(left)) == m
            first = first[enough[i[first]]].reshape(-1, m)
            limit[enough] = np.minimum(limit[enough], (d[first] + spare[j[first]]).max(1) + own[enough])
            kept = d <= limit[i]
            i, j, d = i[kept], j[kept], d[kept]
            held = len(i)
    kept = d <= limit[i]
    return i[kept], j[kept]


def _stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf["z"].to_numpy()), np.array(pdf["id"].tolist())


#: Share of the blocks that a row may have to visit, and their number; where it is more, all_knn() compares all blocks.
MOST_VISITED, MOST_SENT = 0.25, 8
#: Rings of a cell: rows by their distance from its pivot.
RINGS = 256


def _flat(z: np.ndarray, metric: str) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) if metric == "cosine" else z


def _apart(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((z**2).sum(1)[:, None] - 2 * z @ pivots.T + (pivots**2).sum(1)[None], 0))


class _Rings:
    """Which rings of which cells can hold a row within a distance of a query."""

    def __init__(self, pivots: np.ndarray, rings: list):
        self.pivots, self.between = pivots, _apart(pivots, pivots)
        own: dict = {}
        for r in sorted(rings, key=lambda r: (r["cell"], r["ring"])):
            own.setdefault(r["cell"], []).append((r["ring"], r["least"], r["most"]))
        self.own = {c: tuple(np.array(x) for x in zip(*rows, strict=True)) for c, rows in own.items()}
        self.reach = np.array([self.own[c][2][-1] if c in self.own else 0.0 for c in range(len(pivots))])
        # No row's norm is greater.
        self.norm = float((np.linalg.norm(pivots, axis=1) + self.reach).max())

    def needed(self, z: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> list[list[int]]:
        """For each row the numbers cell * RINGS + ring. A cell is out where the plane between its pivot and the own one is too far, a ring where its distances from the pivot are."""
        d, slack = _apart(z, self.pivots), 1e-6 * (self.norm + np.linalg.norm(z, axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[np.arange(len(z)), cell][:, None] ** 2 - 1e-10 * self.norm**2) / (2 * self.between[cell])
        plane = np.where(self.between[cell] > 0, plane, -np.inf)
        out: list[list[int]] = [[] for _ in z]
        near = plane <= (bound + slack)[:, None]
        for c, (ring, least, most) in self.own.items():
            rows = np.flatnonzero(near[:, c])
            low = np.searchsorted(most, d[rows, c] - bound[rows] - slack[rows], "left")
            high = np.searchsorted(least, d[rows, c] + bound[rows] + slack[rows], "right")
            for i, f, t in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True):
                out[i] += (c * RINGS + ring[f:t]).tolist()
        return out


def _visits(rows: DataFrame, k: int, metric: str, cells: int, block_rows: int, most: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows in their blocks (id, z, cell, block), the k nearest of each in its own block, and which other blocks each row has to visit (id, z, cell, block), or None where a sample of the rows has to visit more than ``most`` of all blocks or MOST_SENT."""
    spark, kind = rows.sparkSession, _id_kind(rows)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("z").collect()
    pivots = _flat(np.array([r["z"] for r in picked], np.float64), metric)
    sent = spark.sparkContext.broadcast(pivots)

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                d = _apart(_flat(np.stack(pdf["z"].to_numpy()), metric), sent.value)
                yield pdf.assign(cell=d.argmin(1).astype(np.int32), far=d.min(1))

    dealt = settled(rows.mapInPandas(deal, f"id {kind}, z array<double>, cell int, far double"), "cells")
    # A cell's rows are cut into rings, a ring into blocks; at most MOST_CELLS cells of RINGS rings.
    spread = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)]).alias("far")).collect()
    cuts = []
    for r in spread:
        wanted = min(RINGS, -(-r["n"] // block_rows))
        cuts.append((r["cell"], sorted({r["far"][i * RINGS // wanted - 1] for i in range(1, wanted)})))
    ringed = dealt.join(F.broadcast(spark.createDataFrame(cuts, "cell int, cuts array<double>")), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("far")))).drop("cuts")
    rings = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("pieces"), F.min("far").alias("least"), F.max("far").alias("most"))
    rings = settled(rings, "rings")
    pieces = F.broadcast(rings.select("cell", "ring", "pieces"))
    block = lambda piece: F.shiftleft(F.col("ring").cast("long"), 32) + piece
    placed = ringed.join(pieces, ["cell", "ring"]).withColumn("block", block(F.expr("pmod(xxhash64(id), pieces)"))).select("id", "z", "cell", "block")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stacked(pdf)
        return _best(k, x, ids, x, ids, metric)

    first = settled(placed.groupBy("cell", "block").applyInPandas(own, f"query_id {kind}, id {kind}, dist double"), "nearest")
    # The distance of the k-th in the own block; without k of them, everything may be nearer.
    bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("dist")).alias("bound")).withColumnRenamed("query_id", "id")
    reach = spark.sparkContext.broadcast(_Rings(pivots, rings.collect()))

    def need(batches):
        for pdf in batches:
            if len(pdf):
                b = pdf["bound"].fillna(np.inf).to_numpy()
                b = np.sqrt(2 * b) if metric == "cosine" else b
                targets = reach.value.needed(_flat(np.stack(pdf["z"].to_numpy()), metric), pdf["cell"].to_numpy(), b)
                yield pdf[["id", "z", "cell", "block"]].assign(targets=targets)

    bounded = placed.join(bound, "id", "left").select("id", "z", "cell", "block", "bound")
    needing = lambda t: t.mapInPandas(need, f"id {kind}, z array<double>, cell int, block long, targets array<long>")
    if most is not None:
        # Only which way is taken hangs on the sample, not what is found.
        seen = needing(bounded.where(f"pmod(xxhash64(id), {max(1, sum(r['n'] for r in spread) // 4096)}) = 0")).select("id", F.explode("targets").alias("target"))
        seen = seen.join(pieces, F.col("target") == F.col("cell") * RINGS + F.col("ring")).agg(F.sum("pieces").alias("sent"), F.count_distinct("id").alias("n")).first()
        # Copies of a vector lie in one ring, however many pieces it has.
        if (seen["sent"] or 0) > seen["n"] * min(most * rings.agg(F.sum("pieces")).first()[0], MOST_SENT):
            return placed, first, None
    asked = needing(bounded)
    asked = asked.select("id", "z", F.col("cell").alias("c0"), F.col("block").alias("b0"), F.explode("targets").alias("target"))
    asked = asked.withColumns({"cell": F.floor(F.col("target") / RINGS).cast("int"), "ring": (F.col("target") % RINGS).cast("int")}).join(pieces, ["cell", "ring"])
    asked = asked.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).withColumn("block", block(F.col("_p")))
    return placed, first, settled(asked.where("cell <> c0 or block <> b0").select("id", "z", "cell", "block"), "asked")


def _usable(index: DataFrame) -> DataFrame:
    return index.select("id", F.col("z").cast("array<double>").alias("z")).where("id is not null and z is not null")


def visited_share(index: DataFrame, k: int = K, metric: str = "euclidean", blocks: int | None = None, block_rows: int | None = None) -> float:
    """Distances that all_knn() takes, of all pairs of rows."""
    rows, block_rows = _usable(index), block_rows or QUERY_BLOCK
    total = rows.count()
    placed, _, asked = _visits(rows, k, metric, blocks or max(1, min(MOST_CELLS, -(-total // block_rows))), block_rows)
    held, come = placed.groupBy("cell", "block").agg(F.count("*").alias("n")), asked.groupBy("cell", "block").agg(F.count("*").alias("m"))
    return held.join(come, ["cell", "block"], "left").agg(F.sum(F.col("n") * (F.col("n") + F.coalesce("m", F.lit(0))))).first()[0] / total**2


def all_knn(index: DataFrame, k: int = K, metric: str = "euclidean", blocks: int | None = None, block_rows: int | None = None) -> DataFrame:
    """The k nearest others of every row (id, z), exact; ids keep their type.

    Rows are dealt to the cells of a few pivots, a cell's rows to rings by their distance
    from its pivot, and each row finds its k nearest in its own block first. Their distance bounds what it
    still needs: cells whose side of the plane between both pivots is within it, and of
    those the rings whose distances are. Index rows stay in their block, queries go to the
    blocks they need, and a task holds a block of each. Features leave most blocks out; vectors of
    many independent dimensions are all about equally far, so their rows would visit nearly all blocks (see visited_share());
    where a sample says so, or rows would be sent to more than MOST_SENT blocks, few large blocks are compared instead
    (_nearest_others()), so what is shuffled does not grow with the number of blocks.
    """
    kind, rows, block_rows = _id_kind(index), _usable(index), block_rows or QUERY_BLOCK
    total = rows.count()
    cells = blocks or max(1, min(MOST_CELLS, -(-total // block_rows)))
    found_kind = f"query_id {kind}, id {kind}, dist double"
    rank = lambda d: d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stacked(pdf)
        return _best(k, x, ids, x, ids, metric)

    if cells == 1 and total <= block_rows:
        return rank(rows.groupBy(F.lit(0).alias("b")).applyInPandas(own, found_kind))
    placed, first, asked = _visits(rows, k, metric, cells, block_rows, None if blocks else MOST_VISITED)
    if asked is None:
        return rank(_nearest_others(rows, total, k, metric))
    turns = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("turns"))
    left = asked.join(turns, ["cell", "block"]).withColumn("turn", F.expr("cast(pmod(xxhash64(id), turns) as int)")).select("cell", "block", "turn", "id", "z")
    right = placed.join(turns, ["cell", "block"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("cell", "block", "turn", "id", "z")

    def part(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": q["id"][:0], "id": x["id"][:0], "dist": np.empty(0)})
        return _best(k, *_stacked(x), *_stacked(q), metric)

    more = left.groupBy("cell", "block", "turn").cogroup(right.groupBy("cell", "block", "turn")).applyInPandas(part, found_kind)
    return rank(first.unionByName(more))


def internal_nn(index: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Distance of each row to its nearest other."""
    return all_knn(index, 1, metric).select(F.col("query_id").alias("id"), "dist")


def ood_flags(queries: DataFrame, index: DataFrame, metric: str = "euclidean", quantile: float = 0.95) -> DataFrame:
    """Nearest distance of each query, the index's own 95th percentile, and whether the query is farther."""
    limit = internal_nn(index, metric).agg(F.percentile("dist", quantile).alias("threshold"))
    near = knn(queries, index, 1, metric).select("query_id", F.col("dist").alias("nearest"))
    return near.crossJoin(F.broadcast(limit)).withColumn("ood", F.col("nearest") > F.col("threshold"))


def motif_hits(queries: DataFrame, motifs: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest motif centroids (motif, c) of each query."""
    d = queries.select("id", "z").crossJoin(F.broadcast(motifs)).select(F.col("id").alias("query_id"), "motif", euclidean(F.col("z"), F.col("c")).alias("dist"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", "motif"))).where(F.col("rank") <= k).select("query_id", "rank", "motif", "dist")


def cloud_center(rows: DataFrame, z: str = "z") -> DataFrame:
    """Mean and median of a cloud of vectors, by position."""
    return rows.select(F.posexplode(z).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median"))


def taxa_ranking(queries: DataFrame, index: DataFrame, k: int = 6, prior: float = 5.0) -> DataFrame:
    """Taxa (index: id, z, taxon, label_source) by similarity of their cloud to the query cloud.

    Distance of centroids; mean transport distance per dimension over the index's
    population spread; mean best similarity of the queries within the taxon, shrunk by
    n / (n + prior).
    """
    spread = index.select(F.posexplode("z").alias("pos", "x")).groupBy("pos").agg(F.greatest(F.stddev_pop("x"), F.lit(1e-9)).alias("sd"))
    qlong, ilong = queries.select(F.posexplode("z").alias("pos", "x")), index.select("taxon", F.posexplode("z").alias("pos", "x"))
    qmean, imean = qlong.groupBy("pos").agg(F.avg("x").alias("qm")), ilong.groupBy("taxon", "pos").agg(F.avg("x").alias("im"))
    centre = imean.join(F.broadcast(qmean), "pos").groupBy("taxon").agg(F.sqrt(F.sum((F.col("im") - F.col("qm")) * (F.col("im") - F.col("qm")))).alias("centroid_dist"))
    taxa = index.select("taxon").distinct()
    both = ilong.select("taxon", "pos", F.col("x").alias("value"), F.lit("b").alias("side")).unionByName(qlong.crossJoin(F.broadcast(taxa)).select("taxon", "pos", F.col("x").alias("value"), F.lit("a").alias("side")))
    w = wasserstein(both, ["taxon", "pos"]).join(F.broadcast(spread), "pos").groupBy("taxon").agg(F.avg(F.col("w1") / F.col("sd")).alias("w1_mean"))
    best = nearest_rows(queries, index, 1, within="taxon").groupBy("taxon", "query_id").agg(F.min("dist").alias("d")).groupBy("taxon").agg(F.avg(similarity(F.col("d"))).alias("mean_best"))
    size = index.groupBy("taxon").agg(F.count("*").alias("n"), F.count_if(F.col("label_source") == "human").alias("n_human"))
    out = size.join(centre, "taxon").join(w, "taxon").join(best, "taxon").withColumn("score", F.col("mean_best") * F.col("n") / (F.col("n") + prior))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "taxon"))).where(F.col("rank") <= k)


def similarity_breakdown(pairs: DataFrame, spread: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(pair_id, group, mean_diff) of pairs with columns a_<f> and b_<f>, over spread's population deviations."""
    rows = pairs.crossJoin(F.broadcast(spread))
    parts = [F.struct(F.lit(g).alias("group"), (sum((F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) / F.greatest(F.col(f), F.lit(1e-9)) for f in names), F.lit(0.0)) / len(names)).alias("mean_diff")) for g, names in groups.items()]
    return rows.select("pair_id", F.explode(F.array(*parts)).alias("p")).select("pair_id", "p.group", "p.mean_diff")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard index of the neighbour sets two searches give to the same query."""
    left = a.groupBy("query_id").agg(F.collect_set("id").alias("ia"))
    right = b.groupBy("query_id").agg(F.collect_set("id").alias("ib"))
    both = left.join(right, "query_id")
    return both.select("query_id", (F.size(F.array_intersect("ia", "ib")) / F.size(F.array_union("ia", "ib"))).alias("jaccard"))


def agreement_inside(a: DataFrame, b: DataFrame, flags_a: DataFrame, flags_b: DataFrame) -> DataFrame:
    """agreement() of two representations, over the queries that neither finds novel (query_id, ood): what lies outside has no neighbours to agree on."""
    inside = flags_a.where("not ood").select("query_id").join(flags_b.where("not ood").select("query_id"), "query_id", "left_semi")
    return agreement(a, b).join(inside, "query_id", "left_semi")


def kept_share(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the k neighbours that stay after augmentation."""
    both = a.select("query_id", "id").join(b.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return a.select("query_id").distinct().join(both, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("consistency"))


def same_group_share(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of neighbours from the query's own group (id, grp), and the share that chance gives."""
    q, n = groups.select(F.col("id").alias("query_id"), F.col("grp").alias("qg")), groups.select("id", F.col("grp").alias("ng"))
    got = hits.join(q, "query_id").join(n, "id").agg(F.avg(F.when(F.col("qg") == F.col("ng"), 1.0).otherwise(0.0)).alias("share"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    chance = sizes.agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("chance"))
    return got.crossJoin(chance)


def build_index(episodes: DataFrame, accepted, version: str) -> DataFrame:
    """Rows of a versioned index; kept and rejected counts stand on every row's version."""
    rows = episodes.withColumn("kept", accepted)
    return rows.where("kept").drop("kept").withColumn("version_id", F.lit(version))


def index_metadata(episodes: DataFrame, accepted) -> DataFrame:
    """Kept and rejected episodes and the kept ones of each taxon: (kind, name, n)."""
    rows = episodes.withColumn("kept", F.coalesce(accepted, F.lit(False)))
    counts = rows.groupBy(F.when(F.col("kept"), "kept").otherwise("rejected").alias("name")).agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), "name", "n")
    taxa = rows.where("kept").groupBy(F.col("taxon").alias("name")).agg(F.count("*").alias("n")).select(F.lit("taxon").alias("kind"), "name", "n")
    return counts.unionByName(taxa)


#: Searches by name; each takes (queries, index, k, metric) and gives what knn() does.
BACKENDS: dict = {"exact": knn}


def search(queries: DataFrame, index: DataFrame, k: int = K, metric: str = "euclidean", backend: str = "exact") -> DataFrame:
    """knn() by a registered backend."""
    if backend not in BACKENDS:
        raise ValueError(f"no search backend {backend!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[backend](queries, index, k, metric)
