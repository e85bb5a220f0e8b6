"""Near-duplicate documents by min-max hashing.

1. Every text becomes the set of its distinct word shingles, as sorted 64-bit
   hashes. Documents with the same set form a class, known by 64 bits of its set.
2. Each class gets a signature: for every permutation both the least and the
   greatest value are kept, so half the hash evaluations give as many values.
3. Runs of values are banded into buckets. The smallest class of a bucket is its
   centre; a centre and the classes that share a bucket with it are one group. Any
   two classes of a bucket are in its centre's group, and groups do not chain.
4. Sets of a group are compared in full, first with the centre and with those in
   the same chunk of bounded size. Only sets of large groups that this leaves
   unlinked to the centre meet the group's other chunks.
5. Components of the confirmed links give each document its smallest partner.

The exact mode replaces step 2 by prefixes: two sets at the threshold share one of
the first n - ceil(n * threshold) + 1 hashes in the common order, so sharing these
as buckets loses nothing, at the cost of more buckets for long texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, marked, materialize, spread_join, worker_path
from .graph import components

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MIX = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
BLOCK = 256


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, table: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than size are one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(k):
        acc += h[i : i + n] * _MIX[i % 64]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, count, dtype=np.uint64)


def min_max_signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, side by side."""
    low, high = np.full(len(mul), 2**64 - 1, np.uint64), np.zeros(len(mul), np.uint64)
    for at in range(0, len(shingles), 1024):
        v = mul[:, None] * shingles[None, at : at + 1024]
        v += add[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = len(signature) // rows
    v = signature[: bands * rows].reshape(bands, rows) * _MIX[:rows]
    key = v.sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0x94D049BB133111EB)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def prefix_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The hashes of which any set at the threshold or over shares at least one."""
    n = len(shingles)
    return shingles[: n - -(-percent * n // 100) + 1].view(np.int64)


def _sign(size: int, percent: int, values: int, rows: int, exact: bool):
    mul, add = permutations(values // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = WordHashes(), {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                n, nodes, bands = [], [], []
                for text in texts[at : at + 500]:
                    s = shingle_hashes(text, table, size)
                    node = xxhash.xxh128_intdigest(s.tobytes()) % 2**64 - 2**63 if len(s) else None
                    if node is not None and node not in last:
                        if len(last) > 2_000:
                            last.clear()
                        last[node] = (prefix_keys(s, percent) if exact else band_keys(min_max_signature(s, mul, add), rows)).tolist()
                    n.append(len(s))
                    nodes.append(node)
                    bands.append(last[node] if node is not None else None)
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "node", "bands"])

    return run


def near_matrix(sets: list[np.ndarray], percent: int, rows: np.ndarray) -> np.ndarray:
    """Which of the sets hold 100 * intersection >= percent * union with those of ``rows``: a boolean matrix (rows, sets)."""
    n = np.array([len(s) for s in sets], np.int64)
    which = np.repeat(np.arange(len(sets)), n)
    _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = many[code] > 1
    which, code = which[often], code[often]
    order = np.argsort(code, kind="stable")
    which, code = which[order], code[order]
    column = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    inter = np.zeros((len(rows), len(sets)), np.int64)
    inter[np.arange(len(rows)), rows] = n[rows]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [at, at + 8192])
        m = np.zeros((len(sets), min(8192, int(column[-1]) - at + 1)), np.float32)
        m[which[a:b], column[a:b] - at] = 1
        part = m[rows] @ m.T
        part[np.arange(len(rows)), rows] = 0
        inter += part.astype(np.int64)
    return 100 * inter >= percent * (n[rows][:, None] + n[None, :] - inter)


def linked(sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the pairs at the threshold or over, and which sets it joins with the first one.

    What holds the threshold with the first set is joined already, so only the others
    are compared with all.
    """
    first = near_matrix(sets, percent, np.array([0]))[0]
    out = [(0, int(j)) for j in np.flatnonzero(first) if j]
    group = np.where(first, 0, np.arange(len(sets)))
    others = np.flatnonzero(~first)
    if len(others):
        near = near_matrix(sets, percent, others)
        for i, row in zip(others.tolist(), near, strict=True):
            for j in np.flatnonzero(row).tolist():
                a, b = group[i], group[j]
                if a != b:
                    out.append((i, j))
                    group[group == max(a, b)] = min(a, b)
    return out, group == 0


def crossing(sets: list[np.ndarray], percent: int, side: np.ndarray, loose: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links of loose sets across the two sides, and which loose sets are linked to one that isn't loose.

    Sets that aren't loose are joined with the centre, so one link to any of them is as good as all.
    """
    rows = np.flatnonzero(loose)
    near = near_matrix(sets, percent, rows) & (side[rows][:, None] != side[None, :])
    bound = np.zeros(len(sets), bool)
    bound[rows] = (near & ~loose[None, :]).any(1)
    group, out = np.where(bound, -1, np.arange(len(sets))), []
    for i, row in zip(rows.tolist(), near & loose[None, :], strict=True):
        for j in np.flatnonzero(row).tolist():
            a, b = group[i], group[j]
            if a != b:
                out.append((i, j))
                group[group == max(a, b)] = min(a, b)
    return out, bound


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], size: int) -> Iterator[tuple[tuple, dict]]:
    """(key, {node: (place, loose, set)}) of rows that come sorted by key; a repeated node counts once."""
    table, now, members = WordHashes(), None, {}
    for batch in batches:
        for *k, node, place, loose, text in zip(*(batch.column(c).to_pylist() for c in (*key, "node", "place", "loose", "text")), strict=True):
            if tuple(k) != now:
                if len(members) > 1:
                    yield now, members
                now, members = tuple(k), {}
            if node not in members:
                members[node] = (place, loose, shingle_hashes(text, table, size))
    if len(members) > 1:
        yield now, members


def _links(kind: list[int], u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["kind", "u", "v"])


def _confirm(size: int, percent: int):
    """Links (kind 0) of each chunk of a group, and (kind 1: node, group) what is not joined with the centre yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _), members in _groups(batches, ["grp", "chunk"], size):
            ids = sorted(members, key=lambda x: (x != grp, x))
            pairs, joined = linked([members[x][2] for x in ids], percent)
            left = [x for x, ok in zip(ids, joined, strict=True) if not ok] if ids[0] == grp else ids
            yield _links([0] * len(pairs) + [1] * len(left), [ids[a] for a, _ in pairs] + left, [ids[b] for _, b in pairs] + [grp] * len(left))

    return run


def _confirm_rest(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _, _), members in _groups(batches, ["grp", "i", "j"], size):
            ids = sorted(members)
            side, loose = np.array([members[x][0] for x in ids]), np.array([members[x][1] for x in ids], bool)
            if loose.any():
                pairs, bound = crossing([members[x][2] for x in ids], percent, side, loose)
                tied = [x for x, ok in zip(ids, bound, strict=True) if ok]
                yield _links([0] * (len(pairs) + len(tied)), [ids[a] for a, _ in pairs] + tied, [ids[b] for _, b in pairs] + [grp] * len(tied))

    return run


def bands_for(percent: int, rows: int, miss: float = 1e-4) -> int:
    """Bands of so many rows (an even number of values in all) that miss a pair at the threshold less often than miss."""
    hit = min((percent / 100) ** rows, 1 - 1e-12)
    bands = max(1, math.ceil(math.log(miss) / math.log1p(-hit)))
    return bands + bands * rows % 2


def candidate_stars(classes: DataFrame) -> DataFrame:
    """(grp, node): each centre with the other classes that share one of its buckets. classes (node, bands) is a written table."""
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    total = classes.agg(F.sum(F.size("bands"))).first()[0] or 0
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("grp"), F.max("node").alias("last"), F.count("*").alias("n")).where("last > grp").drop("last")
    return spread_join(buckets, centres, "bucket", "n", total).where("node <> grp").select("grp", "node").distinct()


def confirmed_links(docs: DataFrame, classes: DataFrame, stars: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(u, v): links between classes that hold the threshold on full sets; they join what all such links join.

    docs: doc_id, text, text_hash. classes: node, doc_id, text_hash of one document
    each. stars: grp, node. The latter two are written tables.
    """
    sizes = materialize(stars.groupBy("grp").agg(F.count("*").alias("n"), F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("chunks")), "sizes")
    total = stars.count()
    chunk = F.expr("cast(pmod(xxhash64(node), chunks) as int)")
    placed = spread_join(stars, sizes, "grp", "n", total).select("grp", "node", "chunks", chunk.alias("chunk"))
    centres = sizes.select("grp", F.col("grp").alias("node"), "chunks", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))

    nodes = stars.select("node").union(sizes.select("grp")).distinct()
    needed = classes.select("node", "doc_id", "text_hash").join(nodes, "node", "left_semi")
    key = F.xxhash64("doc_id", "text_hash")
    likely = marked(docs.where("doc_id is not null"), key, needed, key).where("_marked")
    texts = likely.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text")).join(needed, ["doc_id", "text_hash"]).select("node", "text")
    plain = placed.unionByName(centres).join(texts, "node").withColumns({"place": F.lit(0), "loose": F.lit(False)})
    dealt = plain.select("grp", "chunk", "node", "place", "loose", "text").repartition("grp", "chunk").sortWithinPartitions("grp", "chunk")
    found = materialize(dealt.mapInArrow(_confirm(shingle, percent), "kind int, u long, v long"), "links")

    links = found.where("kind = 0").select("u", "v")
    loose = found.where("kind = 1").select(F.col("u").alias("node"), F.col("v").alias("grp")).join(sizes.where("chunks > 1"), "grp").where("node <> grp").select("grp", "node", "chunks", chunk.alias("chunk"))
    if is_empty(loose):
        return links
    # Loose sets meet every other chunk of their group, whole chunks meet those that have loose sets.
    where = loose.select("grp", F.col("chunk").alias("other")).distinct()
    every = placed.join(loose.select("grp", "node"), ["grp", "node"], "left_anti").join(where, "grp").where("chunk <> other").withColumn("loose", F.lit(False))
    moved = loose.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).where("chunk <> other").withColumn("loose", F.lit(True))
    rest = every.select("grp", "node", "chunk", "other", "loose").unionByName(moved.select("grp", "node", "chunk", "other", "loose")).join(texts, "node")
    rest = rest.select("grp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", F.col("chunk").alias("place"), "loose", "text")
    crossed = rest.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_confirm_rest(shingle, percent), "kind int, u long, v long")
    return links.union(crossed.select("u", "v"))


def signatures(docs: DataFrame, percent: int, shingle: int, rows: int, miss: float, exact: bool) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, bands of every row of docs (doc_id, text, text_hash), written."""
    values = rows * bands_for(percent, rows, miss)
    kinds = "doc_id long, text_hash long, n_shingles long, node long, bands array<long>"
    return materialize(docs.mapInArrow(_sign(shingle, percent, values, rows, exact), kinds), "signed")


def set_classes(signed: DataFrame) -> DataFrame:
    """node, doc_id and text_hash of its smallest document, copies, bands of each different set, written."""
    one = F.min(F.struct("doc_id", "text_hash"))
    classes = signed.where("node is not null and doc_id is not null").groupBy("node").agg(one.alias("one"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    return materialize(classes.select("node", "one.doc_id", "one.text_hash", "copies", "bands"), "classes")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, rows: int = 9, miss: float = 1e-4, exact: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, text_hash, group.

    docs needs doc_id and text; other columns are left alone. Two documents are
    linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id that links reach, kept says whether it is
    the document's own. A null text is empty; texts without words are linked with
    nothing and keep themselves. A row without doc_id takes no part in links: its
    component_id is null and it is kept. Repeated rows get the same component and
    are all kept or all not. If one doc_id stands on several texts, each row gets
    the component of its own text. text_hash is xxhash64(text); group tells components
    apart even where they have the same smallest doc_id, and is null for texts that
    take no part.

    A band has ``rows`` values, and there are as many bands as let a pair at the
    threshold be missed with a probability below ``miss``; exact=True misses none.
    Nine rows keep documents that only share a passage out of each other's buckets.
    Sets are told apart by 64-bit hashes.
    """
    worker_path(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("text_hash"))
    signed = signatures(docs, percent, shingle, rows, miss, exact)
    classes = set_classes(signed)
    stars = materialize(candidate_stars(classes), "stars")
    joined = components(confirmed_links(docs, classes, stars, percent, shingle), "u", "v")
    joined = materialize(joined.join(classes.select("node", F.col("doc_id").alias("first")), "node"), "joined")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    known = spread_join(joined, least, "component", "n", joined.count()).select("node", "component", "component_id")
    known = classes.select("node", "doc_id", "copies").join(known, "node", "left")
    known = known.select("node", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"), "copies")
    out = spread_join(signed.drop("bands"), materialize(known, "known"), "node", "copies", signed.count(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))
