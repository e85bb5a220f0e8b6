"""SentencePiece ids by a table of distinct marked words.

The model's pieces never hold a white-space marker behind another character, so no
merge crosses the start of a marked word. Marked words are counted over the corpus;
the frequent ones, a bounded number, are segmented once for all and go to every task,
which joins their ids back by position. Rare words, most of which stand in the corpus
once, are segmented where they stand, once in a stretch of a task. With join_rare
they are segmented once for all, too, and joined back by row and position, which
shuffles the ids of nearly every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import is_empty, materialize, worker_path

MARK = "▁"
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: Frequent words that are broadcast, and the longest of them: 300,000 of 64 characters at most, under 80 MB.
HEAD, LONGEST = 300_000, 64
#: Rare words that a task keeps before it forgets them.
KEPT = 100_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 100_000


@lru_cache(2)
def processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def message(data: bytes) -> dict[int, list]:
    """Fields of a serialized message by number: integers, or bytes of nested ones and strings."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


def check_model(path: str) -> None:
    """Raise ValueError if the model's pieces cross white space, or its normalizer does more than mark white space.

    Fixed values: field numbers of the published format. 3 is the normalizer: 2 its
    character map, 3 the marker put in front, 4 the removal of blanks, 5 their
    marking; 2 is the trainer, with 24 the marker behind words.
    """
    sp = processor(path)
    model = message(sp.serialized_model_proto())
    rules, trained = (message((model.get(n) or [b""])[-1]) for n in (3, 2))
    flag = lambda fields, n, default: bool((fields.get(n) or [default])[-1])
    plain = not flag(rules, 2, b"") and flag(rules, 3, 1) and not flag(rules, 4, 1) and flag(rules, 5, 1) and not flag(trained, 24, 0)
    if not plain or any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model can cross white space, or it changes texts")


def marked_words(text: str | None) -> list[str]:
    """The words of a text, each behind its markers; the first has one put in front."""
    return MARKED.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(sp, words: list[str]) -> list[bytes]:
    """The library's ids of each marked word, little-endian unsigned 32-bit."""
    lone = np.array([sp.piece_to_id(MARK)], "<u4").tobytes()
    # The library puts the first marker back in front.
    return [np.array(ids, "<u4").tobytes() if w != MARK else lone for w, ids in zip(words, sp.encode([w[1:] for w in words], num_threads=1), strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(marked_words(text))
            if len(seen) > COUNTED:
                yield hand_on()
    if seen:
        yield hand_on()


def _segment(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment(sp, batch.column("word").to_pylist()), pa.binary())], [*batch.schema.names, "ids"])

    return run


def word_table(docs: DataFrame, path: str, head: int | None = None) -> DataFrame:
    """word, n, ids: the distinct marked words of the texts of docs, how often they stand there, and their ids, each segmented once; written.

    With head only frequent words of at most LONGEST characters: all that stand there so
    often, or more, that no more than head words do.
    """
    worker_path(docs.sparkSession)
    words = docs.select(docs["text"]).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    if head is not None:
        words = materialize(words.where(F.length("word") <= LONGEST), "counted")
        # How many words stand there n times, for each n: as many rows as there are different counts.
        times = words.groupBy("n").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(W.orderBy(F.desc("n"))))
        least = times.where(F.col("upto") <= head).agg(F.min("n")).first()[0]
        words = words.where(F.col("n") >= least) if least is not None else words.limit(0)
    return materialize(words.mapInArrow(_segment(path), "word string, n long, ids binary"), "words")


def _in_place(path: str, head, first: bytes, last: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known, rare = processor(path), head.value, {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                words = [marked_words(t) for t in texts[at : at + 512]]
                new = list({w for ws in words for w in ws if w not in known and w not in rare})
                rare.update(zip(new, segment(sp, new), strict=True))
                get = lambda w: known.get(w) or rare[w]  # noqa: B023, E731
                ids = [first + b"".join(map(get, ws)) + last for ws in words]
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                if len(rare) > KEPT:
                    rare.clear()

    return run


def _look_up(head, first: bytes, last: bytes):
    """Whole ids where all words are in the head; else runs of known ids, and the others' words with their places."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, uid = head.value, TaskContext.get().partitionId() << 40
        get = ids.get
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for at in range(0, len(texts), 256):
                cols: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(keep[at : at + 256], texts[at : at + 256], strict=True):
                    words = marked_words(text)
                    found = list(map(get, words))
                    whole, runs, rare = None, None, None
                    if None not in found:
                        whole = first + b"".join(found) + last
                    else:
                        holes = [i for i, x in enumerate(found) if x is None]
                        edges = [-1, *holes, len(found)]
                        runs = [b"".join(found[a + 1 : b]) for a, b in zip(edges, edges[1:], strict=False)]
                        rare = [words[i] for i in holes]
                    for col, x in zip(cols, (doc_id, uid, whole, runs, rare), strict=True):
                        col.append(x)
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "uid", "ids", "runs", "rare"])

    return run


def encode_pieces(docs: DataFrame, path: str, bounds: bool = True, head: int = HEAD, join_rare: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit), one row per row of docs; with bounds, begin and end ids stand around them.

    A null text is empty. doc_id may be null or repeated; other columns are left out.
    head bounds the frequent words that every task holds. The model must mark words in
    front and leave texts as they are, see check_model(). join_rare changes where rare
    words are segmented, never the ids.
    """
    check_model(path)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    table = word_table(docs, path, None if join_rare else head)
    picked = table if not join_rare else table.where(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(head)
    picked = picked.select("word", "ids").toArrow()
    known = dict(zip(picked.column("word").to_pylist(), picked.column("ids").to_pylist(), strict=True))
    sc, sp = docs.sparkSession.sparkContext, processor(path)
    first, last = (np.array([i], "<u4").tobytes() if bounds else b"" for i in (sp.bos_id(), sp.eos_id()))
    sent = sc.broadcast(known)
    if not join_rare:
        return docs.mapInArrow(_in_place(path, sent, first, last), "doc_id long, ids binary")
    found = materialize(docs.mapInArrow(_look_up(sent, first, last), "doc_id long, uid long, ids binary, runs array<binary>, rare array<string>"), "looked-up")
    part = found.where("ids is null")
    if is_empty(part):
        return found.select("doc_id", "ids")
    # The join by position: words that are not frequent, so none has many rows.
    spots = part.select("uid", F.posexplode("rare").alias("place", "word"))
    spots = spots.join(table.select("word", F.col("ids").alias("word_ids")), "word")
    rare = spots.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word_ids"))), lambda x: x["word_ids"]).alias("rare_ids"))
    mixed = F.transform("runs", lambda x, i: F.concat(x, F.coalesce(F.get("rare_ids", i), F.lit(b""))))
    joined = part.drop("ids").join(rare, "uid").select("doc_id", F.unhex(F.concat(F.lit(first.hex()), F.array_join(F.transform(mixed, lambda x: F.hex(x)), ""), F.lit(last.hex()))).alias("ids"))
    return found.where("ids is not null").select("doc_id", "ids").unionByName(joined)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for at in range(0, len(ids), 256):
                texts = [sp.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in ids[at : at + 256]]
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text, decoded by the library; null ids are empty."""
    worker_path(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids binary, text string")
