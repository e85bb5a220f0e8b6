"""Order MinHash fingerprints, in DataFrame operations alone.

A text is its sequence of words, and an edit within a word counts like its
replacement. Each k-mer of words is numbered by occurrence, so that repeats differ.
A selection takes the k-mers with the least value under permutations of its own, hashes
seeded by the permutation's number; they keep their order in the text, and the tuple
is hashed. Two texts agree on a selection only if they share these k-mers in the same
order, so the share of equal selections falls with edits and with moved passages.

The two k-mers of a selection are the least under one permutation each, 64 in all,
rather than the two least under one: so each is a plain minimum, which generated code
finds over exploded k-mers. The difference is that both are the same k-mer once in n.

A script without spaces has long words; a text of fewer words than a k-mer is
taken as its characters instead, so that such texts differ by degrees, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KMER, SELECTIONS, TUPLE = 3, 32, 2
_LOW = 0xFFFFFF


def units(text: Column) -> Column:
    """array<long>: hashes of the words; of the characters where there are fewer than three words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.when((F.size(words) < KMER) & (F.size(words) > 0), F.split(F.array_join(words, " "), "")).otherwise(words)
    return F.transform(chosen, lambda w: F.xxhash64(w))


def numbered_kmers(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with column out: array<long>, 40 bits of each occurrence-numbered k-mer's hash above 24 bits of its place (modulo 2^24).

    A text of fewer than three words and characters is one k-mer; one without words
    has none. Occurrences are numbered in the order of the text; beyond 2^24 words
    equal k-mers stay numbered, but a number may belong to another of them.
    """
    t = f"_{out}_"
    docs = docs.withColumn(t + "h", units(F.coalesce(F.col(text), F.lit(""))))
    docs = docs.withColumn(t + "n", F.size(t + "h"))
    kmers = f"""case when {t}n = 0 then cast(array() as array<bigint>) when {t}n < {KMER} then array(xxhash64({t}h))
        else transform(sequence(0, {t}n - {KMER}), i -> xxhash64({", ".join(f"get({t}h, i + {k})" for k in range(KMER))})) end"""
    docs = docs.withColumn(t + "k", F.expr(kmers))
    # Packed into one long each, so that sorting runs on longs.
    docs = docs.withColumn(t + "s", F.expr(f"sort_array(transform({t}k, (h, i) -> (h & ~{_LOW}L) | (i & {_LOW})))")).drop(t + "k", t + "h", t + "n")
    # Equal hashes stand side by side: the first of a run is occurrence 0, the others get new hashes by their number in the run.
    docs = docs.withColumn(t + "f", F.expr(f"filter({t}s, (x, i) -> i = 0 or (x >> 24) <> (get({t}s, i - 1) >> 24))"))
    docs = docs.withColumn(t + "r", F.expr(f"case when size({t}f) = size({t}s) then cast(array() as array<bigint>) else filter({t}s, (x, i) -> i > 0 and (x >> 24) = (get({t}s, i - 1) >> 24)) end")).drop(t + "s")
    starts = f"filter(transform({t}r, (x, i) -> i), i -> i = 0 or (get({t}r, i) >> 24) <> (get({t}r, i - 1) >> 24))"
    docs = docs.withColumn(t + "b", F.expr(starts))
    numbered = f"""case when size({t}r) = 0 then {t}f else concat({t}f, flatten(transform({t}b, (b, q) ->
        transform(slice({t}r, b + 1, coalesce(get({t}b, q + 1), size({t}r)) - b), (x, o) -> (xxhash64(x >> 24, o + 1) & ~{_LOW}L) | (x & {_LOW}))))) end"""
    return docs.withColumn(out, F.expr(numbered)).drop(t + "f", t + "r", t + "b")


def fingerprint(docs: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """The columns ``keys`` of docs, which tell its rows apart, and out: the selections' hashes, an array of 32 longs, for the text column (null: empty).

    A text without words gets a constant fingerprint. Only values of 40 bits and keys
    are grouped, in the tasks where rows already are if docs is partitioned by some of the keys.
    """
    rows = numbered_kmers(docs.select(*keys, text), text, "_kmers").select(*keys, F.explode_outer("_kmers").alias("_x"))
    rows = rows.withColumns({"_h": F.expr("_x >> 24"), "_at": F.expr(f"_x & {_LOW}")})
    value = lambda j: F.min(F.expr(f"if(_x is null, null, (xxhash64(_h, {j}) & ~{_LOW}L) | _at)"))
    least = rows.groupBy(*keys).agg(*[value(j).alias(f"_m{j}") for j in range(TUPLE * SELECTIONS)])
    # Permutations 2j and 2j + 1 select for j; the places in the low bits tell which of the two comes first.
    high = lambda m: f"shiftright({m}, 24)"
    pair = lambda a, b: f"if(({a} & {_LOW}) <= ({b} & {_LOW}), xxhash64({high(a)}, {high(b)}), xxhash64({high(b)}, {high(a)}))"
    chosen = ", ".join(pair(f"_m{2 * j}", f"_m{2 * j + 1}") for j in range(SELECTIONS))
    return least.select(*keys, F.expr(f"if(_m0 is null, array_repeat(0L, {SELECTIONS}), array({chosen}))").alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal selections, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / SELECTIONS


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def in_order(docs: DataFrame, rows_in_bucket: int = 1000) -> tuple[DataFrame, WindowSpec]:
    """doc_id, text, _bucket and _guest, with the window over which lead() is the next row by descending doc_id, after the last row the first.

    Rows go to buckets by ranges of doc_id and are ordered within their bucket; behind
    its last row every bucket gets a copy of the first row of the bucket below. Null
    ids come last; equal ids are ordered by the hash of their text. An id that fills
    buckets, null too, has some to itself, dealt by that hash. A single row is its own successor.
    Null texts are empty. Rows with _guest = 1 are the copies, to be left out after
    the last lead(); windows behind one another need no further shuffle or sort.
    There are at most 20,000 ranges of ids, so in larger tables buckets grow, and sort on disk.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    docs = docs.withColumns({"_key": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "_hash": F.xxhash64("text")})
    total = docs.agg(F.count("*").alias("n")).first()["n"]
    buckets = max(1, min(20_000, total // rows_in_bucket))
    bounds: set[int] = set()
    if buckets > 1:
        cuts = docs.agg(F.percentile_approx("_key", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
        # A range ends with its bound. A bound that comes twice is a frequent id, and gets a range of its own.
        bounds = set(cuts) | {b - 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b and b > -(2**63)}
    limits = sorted(bounds)
    # The number of bounds below the key, by halving.
    steps = max(len(limits).bit_length(), 1)
    array = F.lit(limits).cast("array<long>") if limits else F.array().cast("array<long>")
    docs = docs.withColumn("_limits", array)
    below = f"aggregate(sequence({steps - 1}, 0, -1), 0, (at, s) -> if(coalesce(get(_limits, at + shiftleft(1, s) - 1) < _key, false), at + shiftleft(1, s), at))"
    docs = docs.withColumn("_range", F.expr(below)).drop("_limits")
    # At most 20,000 ranges and as many parts of long ranges that are one id.
    counts = docs.groupBy("_range").agg(F.count("*").alias("n"), (F.min("_key") == F.max("_key")).alias("one")).where(F.col("one") & (F.col("n") > 2 * rows_in_bucket)).collect()
    parts = {r["_range"]: min(14, int(r["n"] // rows_in_bucket).bit_length()) for r in counts}
    if parts:
        split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
        bits = F.coalesce(F.try_element_at(split, F.col("_range")), F.lit(0))
        docs = docs.withColumn("_bits", bits).withColumn("_part", F.expr("if(_bits = 0, 0, cast(shiftrightunsigned(_hash, 64 - _bits) as int))"))
        docs = docs.withColumn("_part", F.expr("if(_bits = 0, 0, cast(pmod(_part + shiftleft(1, _bits - 1), shiftleft(1, _bits)) as int))")).drop("_bits")
    else:
        docs = docs.withColumn("_part", F.lit(0))
    # Signed hashes ascend with their part, and both ascend with _bucket; the order runs downwards.
    docs = docs.withColumn("_bucket", F.expr("_range * 16384L + _part"))
    order = F.struct("_key", "_hash")
    tops = sorted((r["_bucket"], tuple(r["top"])) for r in docs.groupBy("_bucket").agg(F.max(order).alias("top")).collect())
    ends = docs.sparkSession.createDataFrame([(b, *tops[i - 1][1]) for i, (b, _) in enumerate(tops)], "_at long, _key long, _hash long")
    # The first row of the bucket below; where more than one has this id and hash they have one text.
    guests = docs.select("_key", "_hash", "text").join(F.broadcast(ends), ["_key", "_hash"]).groupBy("_at").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_at").alias("_bucket"), F.lit(1).alias("_guest"), F.lit(0).cast("long").alias("_hash"))
    rows = docs.select("doc_id", "text", "_bucket", F.lit(0).alias("_guest"), "_hash").union(guests)
    down = W.partitionBy("_bucket").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc(), "text")
    return rows, down


def edited(text: Column, following: Column) -> Column:
    """text with its last third (rounded down) replaced by the first as many code points of the next, or all of it."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))
