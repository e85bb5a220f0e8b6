"""Prefix tries of conversations, families first.

A conversation id's base is the id less its remainder by 20. All conversations of
a base are one family: they are cogrouped by it, the base first, so each is rebuilt
from the base's opening turns while the rows stream by, and the family's small trie is
built and summed up in the same pass. Only combined family nodes, without texts,
are shuffled again. A node that stands in one family has its whole subtree there, so
the family's sums are final; nodes that several families share are few, and their
sums climb to their ancestors by pointer doubling, in as many rounds as the
logarithm of their depth.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialize, release, spread_join, worker_path

FAMILY = 20
ROOT = bytes(16)
#: Nodes that a task holds before it hands on what it has; a family may be handed on in several pieces.
MOST = 200_000
#: Characters of a list of ids that travel as one row.
CHUNK = 1 << 16
NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, words long, leaves long, saved long, ends array<long>, open boolean"


def borrowed(conv: int) -> int:
    """How many opening turns of its base a conversation takes."""
    return zlib.crc32(str(conv).encode()) % 4


def child_key(key: bytes, turn: bytes) -> bytes:
    """128 bits that stand for a sequence of turns: the shorter sequence's and the last turn's, hashed."""
    return xxhash.xxh3_128_digest(key + turn)


class Trie:
    """Nodes by key: [parent, depth, smallest member, members, words, ends, open]."""

    def __init__(self, most: int):
        self.nodes: dict[bytes, list] = {}
        self.most, self.key, self.parent, self.depth, self.words, self.conv = most, ROOT, ROOT, 0, 0, None

    def _visit(self, n: int) -> list:
        node = self.nodes.get(self.key)
        if node is None:
            node = self.nodes[self.key] = [self.parent, self.depth, self.conv, 0, self.words, [], False]
        node[2], node[3] = min(node[2], self.conv), node[3] + n
        return node

    def start(self, conv: int) -> Iterator[pa.RecordBatch]:
        if len(self.nodes) >= self.most:
            yield from self.emit(False)
        self.key, self.parent, self.depth, self.words, self.conv = ROOT, ROOT, 0, 0, conv
        self._visit(1)

    def turn(self, turn: bytes, words: int) -> Iterator[pa.RecordBatch]:
        if len(self.nodes) >= self.most:
            yield from self.emit(True)
        self.parent, self.key, self.depth, self.words = self.key, child_key(self.key, turn), self.depth + 1, words
        self._visit(1)

    def end(self) -> None:
        if self.conv is not None:
            self._visit(0)[5].append(self.conv)
            self.conv = None

    def emit(self, within: bool) -> Iterator[pa.RecordBatch]:
        """All nodes with their sums; within: the present conversation goes on, so its nodes' subtrees are open."""
        key = self.key if within else None
        while key in self.nodes and not self.nodes[key][6]:
            self.nodes[key][6], key = True, self.nodes[key][0]
        sums: dict[bytes, list[int]] = {}
        done = sorted(self.nodes.items(), key=lambda x: -x[1][1])
        for k, (parent, depth, _, n, words, _, _) in done:
            own = sums.setdefault(k, [0, 0])
            own[0], own[1] = own[0] or 1, own[1] + (n - 1) * words
            if depth and parent in self.nodes:
                up = sums.setdefault(parent, [0, 0])
                up[0], up[1] = up[0] + own[0], up[1] + own[1]
        self.nodes = {}
        for at in range(0, len(done), 10_000):
            rows = [(k, p, d, c, n, w, *sums[k], sorted(e) or None, o) for k, (p, d, c, n, w, e, o) in done[at : at + 10_000]]
            kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.bool_()]
            names = [c.split()[0] for c in NODE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _walk(most: int):
    """Family tries of rows that come sorted by family, base first, conversation, turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, family, conv, opening, skip = Trie(most), None, None, [], 0
        for batch in batches:
            for fam, c, turn, words in zip(*(batch.column(x).to_pylist() for x in ("family", "conv_id", "hash", "words")), strict=True):
                if c != conv:
                    trie.end()
                    if fam != family:
                        yield from trie.emit(False)
                        family, opening = fam, []
                    conv, skip = c, 0
                    yield from trie.start(c)
                    if c != fam:
                        skip = borrowed(c)
                        for t, w in opening[:skip]:
                            yield from trie.turn(t, w)
                if c == fam and len(opening) < 3:
                    opening.append((turn, words))
                if skip:
                    skip -= 1
                else:
                    yield from trie.turn(turn, words)
        trie.end()
        yield from trie.emit(False)

    return run


def family_nodes(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Nodes of each family's trie (see NODE), written. rows: conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"),
        "conv_id",
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("hash"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    # The texts stay behind: a turn travels as 16 bytes and its number of words.
    dealt = turns.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", "turn", "hash")
    return materialize(dealt.select("family", "conv_id", "hash", "words").mapInArrow(_walk(most), NODE), "families")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that come sorted by key and id, comma-joined in rows of bounded length: key, first id, text."""
    now, first, ids, size, out = None, None, [], 0, []

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "first", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != now or size > CHUNK:
                if ids:
                    out.append((now, first, ",".join(ids)))
                if len(out) >= 5_000 or size > CHUNK:
                    yield rows(out)
                    out = []
                now, first, ids, size = key, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((now, first, ",".join(ids)))
    if out:
        yield rows(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's chunks, which come in order; one chunk is held at a time."""
    now, sha = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])


def end_digests(families: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end.

    Ids are sorted over all tasks and joined into chunks there, so that the digest of a
    node where very many conversations end, which has to be made in order, reads few rows.
    """
    ends = families.where("ends is not null").select("key", F.explode("ends").alias("conv_id"))
    chunks = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(key, leaves, saved) summed over each node's subtree, by pointer doubling. nodes: key, up (null at the top), leaves, saved; written.

    After r rounds a node has the sums of all below it within a distance of 2^r, and
    knows its ancestor at that distance.
    """
    now = nodes
    while not is_empty(now.where("up is not null")):
        sums = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("n"))
        met = materialize(now.join(sums, "key", "left").select("key", "up", "leaves", "saved", "l", "s", "n"), "met")
        above = met.where("n is not null").select(F.col("key").alias("up"), F.col("up").alias("next"), "n")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        # Nodes that have reached the top need no join, and have no key for one.
        live = spread_join(met.where("up is not null").drop("n"), above, "up", "n", met.count(), "left").withColumn("up", F.col("next")).drop("next")
        moved = live.unionByName(met.where("up is null").drop("n")).select("key", "up", plus("leaves", "l"), plus("saved", "s"))
        new = materialize(moved, "sums")
        release(met)
        release(now)
        now = new
    return now.select("key", "leaves", "saved")


def prefix_trie(rows: DataFrame, most: int = MOST) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, key, parent: the smallest member, the number of turns, the parent's
    smallest member (null at the root), members, children, childless nodes in the
    subtree, the sum over the subtree of (members - 1) times the words of the node's last
    turn, the digest of the members that end here, and 128 bits that name the node and
    its parent.

    A conversation is rebuilt from the first h turns of its base (as many as there are)
    and its own turns after the first h; h = crc32(id) % 4. Turns are in the order of
    ``turn``, null first; turns with equal numbers, repeated rows among them, in the order
    of their md5. A null role or text is empty. Rows without conv_id belong to no
    conversation and leave; other columns are left alone. No conversations give no
    nodes, not even a root. A task holds ``most`` nodes at a time.
    """
    worker_path(rows.sparkSession)
    families = family_nodes(rows, most)
    agg = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words")]
    agg += [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), ((F.count("*") > 1) | F.max("open")).alias("shared")]
    nodes = materialize(families.groupBy("key").agg(*agg), "nodes")
    alone = lambda c: F.sum(F.when(~F.col("shared"), F.col(c)).otherwise(0))
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), alone("leaves").alias("kids_leaves"), alone("saved").alias("kids_saved"))
    nodes = materialize(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "children")
    own = F.when(F.col("n_children") == 0, 1).otherwise(F.col("kids_leaves")).cast("long")
    top = nodes.where("shared").select(
        "key",
        F.when(F.col("depth") > 0, F.col("parent")).alias("up"),
        own.alias("leaves"),
        (F.coalesce("kids_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    sums = subtree_sums(materialize(top, "shared")).withColumnsRenamed({"leaves": "_leaves", "saved": "_saved"})
    whole = nodes.join(sums, "key", "left").join(end_digests(families), "key", "left").select(
        "key",
        F.when(F.col("depth") > 0, F.col("parent")).alias("parent"),
        "conv_id",
        "depth",
        "n_convs",
        "n_children",
        F.coalesce("_leaves", "leaves").alias("n_leaves"),
        F.coalesce("_saved", "saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    whole = materialize(whole, "trie")
    parents = whole.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    out = spread_join(whole, parents, "parent", "_n", whole.count(), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "parent")
