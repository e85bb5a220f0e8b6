"""Best-fit packing planned on the histogram of lengths.

The plan works on counts, not documents: lengths are taken from the longest down,
and all pieces of one length go to the sequences with the least room that still
holds them, as best-fit would do one at a time. Pieces then learn their place by
their rank within their length. The histogram and the plan have at most a few
rows for each possible length, whatever the number of documents.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, worker_path, worker_table

SPECIAL = re.compile(r"<\|[^|]*\|>")
BLANKS = re.compile(r" (?:\s|$)")
BEFORE_WORD = re.compile(r"(?= \S)")
TABLE = 250_000
# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def tokenizer(path: str):
    # Spark runs a worker on each core; the library's own threads would fight over them.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """Ids of whole texts, by tables of the words seen lately.

    Byte-level pre-tokens never cross a space that a visible character follows, so a
    text is cut there, and each distinct word behind a space is encoded once. New words
    are encoded as one text, by the same merges in a faster library, and cut apart
    by the lengths of their bytes. Special tokens in a text change what follows them;
    such texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tok, self.first, self.spaced, self.odd = tokenizer(path), {}, {}, {}
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        at = byte_alphabet()
        ranks = {bytes(at[c] for c in piece): i for piece, i in self.tok.get_vocab().items() if piece not in special}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, table: dict[str, bytes], words: set[str]) -> None:
        new = [w for w in words if w not in table]
        table.update(zip(new, self._bytes(new), strict=True))

    def _learn_spaced(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.spaced]
        if not new:
            return
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(new)), "<u4")
        ends = self.size[ids].cumsum()
        cuts = np.searchsorted(ends, np.fromiter((len(w.encode()) + 1 for w in new), np.int64, len(new)).cumsum()) + 1
        data, at = ids.tobytes(), 0
        for w, cut in zip(new, (4 * cuts).tolist(), strict=True):
            self.spaced[w] = data[at:cut]
            at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for table in (self.first, self.spaced, self.odd):
            if len(table) > TABLE:
                table.clear()
        cut: list[tuple[str, list[str]]] = []
        heads, words, chunks = set(), set(), set()
        for t in texts:
            if SPECIAL.search(t):
                cut.append(("whole", [t]))
            elif BLANKS.search(t):
                parts = BEFORE_WORD.split(t)
                chunks.update(parts)
                cut.append(("odd", parts))
            else:
                parts = t.split(" ")
                heads.add(parts[0])
                words.update(parts[1:])
                cut.append(("words", parts))
        self._learn(self.first, heads)
        self._learn_spaced(words)
        self._learn(self.odd, chunks)
        out = []
        for how, parts in cut:
            if how == "whole":
                out += self._bytes(parts)
            elif how == "odd":
                out.append(b"".join(map(self.odd.__getitem__, parts)))
            else:
                out.append(self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:])))
        return out


def _pieces(path: str, size: int, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seen = worker_table(WordIds, path), TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for at in range(0, len(texts), 512):
                cols: list[list] = [[], [], [], [], [], []]
                encoded = table.encode([t or "" for t in texts[at : at + 512]])
                for doc_id, ids in zip(keep[at : at + 512], encoded, strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n, size), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        nth = seen[b - a] = seen.get(b - a, -1) + 1
                        for col, x in zip(cols, (doc_id, k, a, b - a, ids[4 * a : 4 * b], nth), strict=True):
                            col.append(x)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(cols[0]), pa.int64())], ["doc_id", "piece", "start", "length", "ids", "nth", "part"])

    return run


def token_pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every row of docs, with nth and part for pack().

    A null text is empty and gives its end id alone. A document longer than size is
    cut so that all pieces but the first are full. doc_id may be null or repeated:
    every row gives pieces of its own.
    """
    worker_path(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return docs.mapInArrow(_pieces(path, size, np.array([end_id], "<u4").tobytes()), "doc_id long, piece int, start long, length long, ids binary, nth long, part long")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, first rank, pieces, first sequence, pieces in each sequence, offset).

    Sequences with equal room are kept as ranges of numbers. A length fills the
    ranges with the least room first, each sequence with as many pieces as it holds,
    then opens new sequences.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first, count)
    rooms: list[int] = []
    out, opened = [], 0

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append((first, n))

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
            else:
                r, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = r // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, each, size - r))
                rank, left = rank + full * each, left - full * each
                put(r - each * length, first, full)
            if full < n and left:
                out.append((length, rank, left, first + full, left, size - r))
                put(r - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(r, first + full, n - full)
    return out


def _ranked(names: list[str]):
    """Number the pieces of each length within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            nth = []
            for length in batch.column("length").to_pylist():
                seen[length] = nth.append(seen.get(length, 0)) or nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([part] * len(nth), pa.int64()), pa.array(nth, pa.int64())], [*names, "part", "nth"])

    return run


def pack(pieces: DataFrame, size: int = 1024, numbered: bool = False) -> DataFrame:
    """pieces with sequence_id and offset: every piece has a place of its own, gapless from 0.

    pieces needs a column length of 1 to size (others raise an error); all other
    columns go along, but sequence_id, offset, part and nth are replaced. Equal
    lengths are told apart by their order alone. No pieces give no rows. Pieces of
    token_pieces() come numbered (nth within length and part); with numbered=False that
    is done here.
    """
    worker_path(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset") if numbered else pieces.drop("sequence_id", "offset", "part", "nth")
    names = [n for n in pieces.columns if n not in ("part", "nth")]
    kinds = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names)
    ranked = materialize(pieces if numbered else pieces.mapInArrow(_ranked(names), f"{kinds}, part long, nth long"), "pieces")
    parts = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).limit(size + 2).collect()}
    if any(k is None or not 1 <= k <= size for k in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    steps = plan(counts, size)
    key = np.array([s[0] for s in steps], np.int64) if steps else np.empty(0, np.int64)
    rest = np.array([s[1:] for s in steps], np.int64).reshape(-1, 5)
    at: dict[int, tuple[int, int]] = {}
    for i, k in enumerate(key.tolist()):
        at[k] = (at[k][0] if k in at else i, i + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length).tolist():
                a, b = at[k]
                mine = np.flatnonzero(length == k)
                step = rest[a + np.searchsorted(rest[a:b, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - step[:, 0]
                seq[mine] = step[:, 2] + nth // step[:, 3]
                off[mine] = step[:, 4] + nth % step[:, 3] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    ranks = ranked.join(parts.drop("n"), ["length", "part"]).select(*[ranked[n] for n in names], (F.col("before") + F.col("nth")).alias("rank"))
    return ranks.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
