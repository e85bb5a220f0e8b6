"""Approximate nearest neighbours by balanced posting lists.

Vectors are dealt to the lists of their nearest centroids; a boundary vector, whose
other centroids are nearly as near, is replicated to several lists. Centroids fit
in memory and are searched by a graph of neighbours. A query reads every list whose
centroid is within a ratio of the distances of the nearest ones. The ratio is fitted: the
smallest by which vectors of the sample find the wanted share of their neighbours.

Clusters are split until a list has few entries; lists that outgrow the bound once
all vectors are dealt are split again where they lie, and queries choose among their
parts by the same ratio. Equal vectors are one entry with its smallest ids, so that a
vector that fills a third of the table does not fill a list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, worker_path

#: Entries of a list that one task holds at once, queries that meet them at once, and rows that a task keeps before it hands on the best.
BLOCK, ASKED, BEST = 4096, 1024, 50_000
#: Nearest centroids whose mean distance the ratio refers to: a single one may be the query itself.
NEAR = 8


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>): rows with an id and a finite, non-zero vector of the most common length (of equally common ones the longest).

    Repeated (id, vector) rows count once; other columns are left out.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).distinct()


def entries(vectors: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector: entry (its smallest id), v, ids (its ``most`` smallest ids; a search for fewer needs no other)."""
    first = vectors.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= most)
    return first.groupBy("v").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each row, by k-means whose distances grow with a cluster's size."""
    centre, load = x[rng.choice(len(x), k, replace=False)].copy(), np.ones(k)
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        for at in range(0, len(x), 4096):
            d = squared(x[at : at + 4096], centre)
            near[at : at + 4096] = (d + 0.05 * d.min(1).mean() * (load / load.mean() - 1)[None]).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        full = count > 0
        centre[full] = total[full] / count[full, None]
        centre[~full] = x[rng.choice(len(x), int((~full).sum()))]
        load = 0.5 * load + 0.5 * np.maximum(count, 1)
    return near


def balanced_parts(x: np.ndarray, most: float, rng: np.random.Generator, fan: int = 64, rounds: int = 8) -> list[np.ndarray]:
    """Row numbers of the clusters of x, split until none has more than ``most`` rows.

    Clusters that k-means cannot split, as those of equal rows, are cut in order.
    """
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= max(most, 1):
            out.append(rows)
            continue
        k = int(min(fan, np.ceil(len(rows) / max(most, 1))))
        near = _kmeans(x[rows], k, rounds, rng)
        parts = [rows[near == j] for j in range(k)]
        if max(map(len, parts)) == len(rows):
            parts = np.array_split(rows, k)
        todo += [p for p in parts if len(p)]
    return out


def balanced_centroids(sample: np.ndarray, most: float, seed: int = 5) -> np.ndarray:
    """Centres of clusters of at most ``most`` rows of the sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return np.stack([sample[rows].mean(0) for rows in balanced_parts(sample, most, rng)])


class CentroidGraph:
    """Centroids with links to their nearest ones and a few far ones; best-first search from the entry point."""

    def __init__(self, centre: np.ndarray, degree: int = 16, seed: int = 3):
        self.centre, self.width = centre, 64
        n = len(centre)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.links = []
        norm = (centre**2).sum(1)
        for at in range(0, n, 1024):
            d = norm[at : at + 1024, None] - 2 * centre[at : at + 1024] @ centre.T + norm[None]
            near = np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1]
            self.links += [np.unique(np.concatenate([x, rng.integers(0, n, 4)])) for x in near]
        back: list[set[int]] = [set() for _ in range(n)]
        for i, x in enumerate(self.links):
            for j in x:
                back[int(j)].add(i)
        self.links = [np.array(sorted({*x.tolist(), *b} - {i}), np.int64) for i, (x, b) in enumerate(zip(self.links, back, strict=True))]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of about ``width`` near centroids, nearest first."""
        seen = np.zeros(len(self.centre), bool)
        d0 = float(((self.centre[0] - q) ** 2).sum())
        seen[0] = True
        todo, best = [(d0, 0)], [(-d0, 0)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for dj, j in zip(((self.centre[new] - q) ** 2).sum(1).tolist(), new.tolist(), strict=True):
                if len(best) < width or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > width:
                        heapq.heappop(best)
        got = sorted((-d, j) for d, j in best)
        return np.array([j for _, j in got], np.int64), np.sqrt(np.array([d for d, _ in got]))

    def within(self, q: np.ndarray, ratio: float, least: int, sizes: np.ndarray) -> tuple[np.ndarray, float]:
        """All lists within the ratio, at least those nearest ones that hold ``least`` entries, and the distance the ratio refers to.

        The search is widened until the last list it finds is not needed any more, and
        begins as wide as the one before had to be.
        """
        width = self.width
        while True:
            at, d = self.search(q, width)
            base = float(d[:NEAR].mean())
            need = max(int((d <= ratio * base).sum()), int(np.searchsorted(np.cumsum(sizes[at]), least)) + 1)
            if need < len(at) or len(at) == len(self.centre) or width > len(self.centre):
                self.width = max(64, 5 * need // 4)
                return at[:need], base
            width *= 2


def dealt_lists(x: np.ndarray, centre: np.ndarray, replicate: float, copies: int) -> list[np.ndarray]:
    """Lists of each row: its nearest centroid's, and those nearly as near."""
    out: list[np.ndarray] = []
    k = min(copies, len(centre))
    for at in range(0, len(x), 1024):
        d = np.sqrt(squared(x[at : at + 1024], centre))
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        dn = np.take_along_axis(d, near, 1)
        out += [a[b <= replicate * b.min()] for a, b in zip(near, dn, strict=True)]
    return out


def fitted_ratio(sample: np.ndarray, centre: np.ndarray, k: int, recall: float, replicate: float, copies: int, asked: int = 300) -> float:
    """The smallest ratio by which rows of the sample find the wanted share of their k nearest others.

    Lists are as dense in the whole table as here or denser, so neighbours are nearer
    there and the ratio holds or is more than enough.
    """
    if len(sample) <= k + 1:
        return float("inf")
    rows = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(np.int64)
    truth = np.empty((len(rows), k), np.int64)
    for at in range(0, len(rows), 32):  # so that few rows of distances stand at once
        some = rows[at : at + 32]
        d = squared(sample[some], sample)
        d[np.arange(len(some)), some] = np.inf
        truth[at : at + 32] = np.argpartition(d, k - 1, axis=1)[:, :k]
    far = np.sqrt(squared(sample[rows], centre))
    near = min(NEAR, len(centre))
    far /= np.maximum(np.partition(far, near - 1, axis=1)[:, :near].mean(1), 1e-300)[:, None]
    lists = dealt_lists(sample[truth.ravel()], centre, replicate, copies)
    needed = np.sort([far[i // k, own].min() for i, own in enumerate(lists)])
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def _deal(centre, replicate: float, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("v").flatten()).reshape(len(batch), -1)
            lists = [own.tolist() for own in dealt_lists(x, centre.value, replicate, copies)]
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("v"), batch.column("ids"), pa.array(lists, pa.list_(pa.int64()))], ["entry", "v", "ids", "lists"])

    return run


def _split(most: int):
    """Parts of at most ``most`` entries within a block of a list."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, part = np.stack(pdf["v"].to_numpy()), np.zeros(len(pdf), np.int32)
        order = np.argsort(pdf["entry"].to_numpy())
        for i, rows in enumerate(balanced_parts(x[order], most, np.random.Generator(np.random.PCG64(1)))):
            part[order[rows]] = i
        return pdf.assign(part=part)

    return run


def _probe(graph, ratio: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, sizes = graph.value
        for batch in batches:
            lists, limits = [], []
            for q in batch.column("q").to_pylist():
                at, base = g.within(np.array(q), ratio, least, sizes)
                lists.append(at.tolist())
                limits.append(ratio * base)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(limits, pa.float64()), pa.array(lists, pa.list_(pa.int64()))], ["query_id", "q", "reach", "lists"])

    return run


class Best:
    """The k best ids of each query that a task has met; handed on when there are many rows."""

    def __init__(self, k: int):
        self.k, self.rows, self.parts = k, 0, []

    def add(self, qid: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        self.parts.append((qid, ids, d))
        self.rows += len(qid)

    def take(self) -> pa.RecordBatch:
        qid, ids, d = (np.concatenate([p[i] for p in self.parts] or [np.empty(0, t)]) for i, t in enumerate(("int64", "int64", "float64")))
        order = np.lexsort((ids, d, qid))
        qid, ids, d = qid[order], ids[order], d[order]
        again = np.concatenate([[False], (qid[1:] == qid[:-1]) & (ids[1:] == ids[:-1])]) if len(qid) else np.empty(0, bool)
        qid, ids, d = qid[~again], ids[~again], d[~again]
        first = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]])) if len(qid) else np.empty(0, np.int64)
        nth = np.arange(len(qid)) - np.repeat(first, np.diff([*first, len(qid)]))
        keep = nth < self.k
        self.parts, self.rows = [(qid[keep], ids[keep], d[keep])], int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.array(qid[keep]), pa.array(ids[keep]), pa.array(d[keep])], ["query_id", "vec_id", "score"])


def _nearest(k: int, least: int):
    """The k nearest rows for each query, of the blocks that come sorted by (list, block, asked), entries before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, posts, x, ids, starts, owners, centres, part = Best(k), None, [], None, None, None, None, None, None

        def prepare() -> None:
            nonlocal x, ids, starts, owners, centres, part
            x = np.concatenate([p[0] for p in posts])
            part = np.concatenate([p[1] for p in posts])
            each = [i for p in posts for i in p[2]]
            owners = np.repeat(np.arange(len(each)), [len(i) for i in each])
            ids = np.concatenate([np.asarray(i, np.int64) for i in each])
            n = int(part.max()) + 1
            count = np.bincount(part, minlength=n)
            centres = np.zeros((n, x.shape[1]))
            np.add.at(centres, part, x)
            centres /= np.maximum(count, 1)[:, None]
            starts = count

        def ask(qid: np.ndarray, q: np.ndarray, reach: np.ndarray) -> None:
            for i in range(len(qid)):
                rows = slice(None)
                if len(centres) > 1:
                    d = np.sqrt(((centres - q[i]) ** 2).sum(1))
                    order = np.argsort(d, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(starts[order]), least)) + 1
                    chosen = np.zeros(len(centres), bool)
                    chosen[order[:enough]] = True
                    chosen |= d <= reach[i]
                    rows = np.flatnonzero(chosen[part])
                dist = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
                mine = np.arange(len(x))[rows]
                # One more entry than k: the query's own may be among them.
                cut = np.partition(dist, k)[k] if len(dist) > k + 1 else np.inf
                full = np.full(len(x), np.inf)
                full[mine] = np.where(dist <= cut, dist, np.inf)
                got = full[owners]
                take = np.flatnonzero((got < np.inf) & (ids != qid[i]))
                best.add(np.full(len(take), qid[i]), ids[take], got[take])

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("list", "block", "asked")), strict=True))
            query = np.asarray(batch.column("is_query"))
            at = 0
            while at < len(batch):
                end = at + 1
                while end < len(batch) and key[end] == key[at] and query[end] == query[at]:
                    end += 1
                rows = batch.slice(at, end - at)
                v = np.asarray(rows.column("v").flatten()).reshape(end - at, -1)
                if key[at] != now:
                    now, posts, x = key[at], [], None
                if not query[at]:
                    posts.append((v, np.asarray(rows.column("part")), rows.column("ids").to_pylist()))
                elif posts:
                    if x is None:
                        prepare()
                    ask(np.asarray(rows.column("id")), v, np.asarray(rows.column("reach")))
                    if best.rows > BEST:
                        best.take()
                        if best.rows > BEST // 2:
                            yield best.take()
                            best.parts, best.rows = [], 0
                at = end
        if best.rows:
            yield best.take()

    return run


@dataclass
class Index:
    """posts (list, block, part, entry, v, ids), blocks (list, n, blocks), and what a query needs to choose lists."""

    posts: DataFrame
    blocks: DataFrame
    graph: CentroidGraph
    sizes: np.ndarray
    ratio: float
    copies: int
    width: int
    entries: int


def build_index(rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", posting: int = 64, sample: int = 50_000, sample_bytes: int = 64 << 20, most_lists: int = 16_384, replicate: float = 1.25, copies: int = 4, recall: float = 0.95) -> Index | None:
    """The index of rows for searches of up to k neighbours; None if no row has a usable vector.

    Centroids are fitted on at most ``sample`` distinct vectors (and sample_bytes), those whose
    ids hash lowest; every row is indexed. There are as many lists as the table needs
    at ``posting`` entries each, replicas included, and most_lists at most, so the broadcast
    centroids are bounded. A list with more entries than ``posting`` is split into parts within
    blocks of bounded size. copies bounds the lists of one entry, replicate how much
    farther than the nearest centroid another one may be. recall is the share of
    neighbours that the sample must find; 1 or more makes every search exact, as it
    reads all lists.
    """
    spark = rows.sparkSession
    worker_path(spark)
    clean = materialize(clean_vectors(rows, id_col, vector_col), "vectors")
    base = materialize(entries(clean, k + 1), "entries")
    total = base.count()
    if not total:
        return None
    width = len(base.select("v").first()[0])
    most = max(1, min(sample, sample_bytes // (8 * width)))
    picked = base.select("entry", "v").orderBy(F.xxhash64("entry"), "entry").limit(most).select("v").toArrow()
    fitted = np.asarray(picked.column("v").combine_chunks().flatten()).reshape(len(picked), -1)
    lists = max(1, min(most_lists, -(-total * copies // posting), len(fitted)))
    centre = balanced_centroids(fitted, len(fitted) / lists)[:most_lists]
    ratio = float("inf") if recall >= 1 else fitted_ratio(fitted, centre, k, recall, replicate, copies)
    ctx = spark.sparkContext
    kinds = "v array<double>, ids array<long>, lists array<long>"
    posts = base.select("entry", "v", "ids").mapInArrow(_deal(ctx.broadcast(centre), replicate, copies), f"entry long, {kinds}")
    posts = materialize(posts.select("entry", "v", "ids", F.explode("lists").alias("list")), "lists")
    # At most most_lists rows.
    blocks = materialize(posts.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    sizes = np.zeros(len(centre), np.int64)
    for r in blocks.collect():
        sizes[r["list"]] = r["n"]
    posts = posts.join(F.broadcast(blocks), "list").withColumn("block", F.expr("cast(pmod(xxhash64(entry), blocks) as int)"))
    long = posts.where(F.col("n") > posting).select("list", "block", "entry", "v", "ids")
    parted = long.withColumn("part", F.lit(0)).groupBy("list", "block").applyInPandas(_split(posting), "list long, block int, entry long, v array<double>, ids array<long>, part int")
    short = posts.where(F.col("n") <= posting).select("list", "block", "entry", "v", "ids", F.lit(0).alias("part"))
    return Index(materialize(short.unionByName(parted), "posts"), blocks, CentroidGraph(centre), sizes, ratio, copies, width, total)


def probes(index: Index, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, q, reach, list: the lists each usable query reads, by the ratio; at least those nearest that surely hold more than k different entries."""
    asked = clean_vectors(queries, id_col, vector_col).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).where(F.size("q") == index.width)
    ctx = queries.sparkSession.sparkContext
    run = _probe(ctx.broadcast((index.graph, index.sizes)), index.ratio, index.copies * (k + 1))
    # Few bytes, but a search each: over all cores.
    found = asked.repartition(ctx.defaultParallelism).mapInArrow(run, "query_id long, q array<double>, reach double, lists array<long>")
    return found.select("query_id", "q", "reach", F.explode("lists").alias("list"))


def search_index(index: Index, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest entries in the lists each query reads."""
    found = materialize(probes(index, queries, k, id_col, vector_col), "probes")
    asked = found.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns"))
    # At most most_lists rows.
    lists = F.broadcast(materialize(index.blocks.join(asked, "list"), "asked"))
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    q = found.join(lists, "list").withColumn("asked", F.expr("cast(pmod(xxhash64(query_id), turns) as int)")).withColumn("block", every("blocks"))
    q = q.select("list", "block", "asked", F.lit(True).alias("is_query"), F.col("query_id").alias("id"), F.col("q").alias("v"), F.lit(0).alias("part"), F.array().cast("array<long>").alias("ids"), "reach")
    p = index.posts.join(lists, "list").withColumn("asked", every("turns"))
    p = p.select("list", "block", "asked", F.lit(False).alias("is_query"), F.col("entry").alias("id"), "v", "part", "ids", F.lit(0.0).alias("reach"))
    dealt = p.unionByName(q).repartition("list", "block", "asked").sortWithinPartitions("list", "block", "asked", "is_query")
    best = dealt.mapInArrow(_nearest(k, index.copies * (k + 1)), "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest rows of each query by Euclidean distance, ties to the smaller id.

    rows and queries have the two named columns; a row with the query's own id is no
    candidate. settings are those of build_index(). Vectors that are null, zero, not
    finite, hold nulls or differ in length take no part; fewer candidates than k give
    all of them, and a query always gets k where there are as many. No usable rows
    give no result.
    """
    index = build_index(rows, k, id_col, vector_col, **settings)
    if index is None:
        none = queries.select(queries[id_col].cast("long").alias("query_id")).limit(0)
        return none.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    return search_index(index, queries, k, id_col, vector_col)
