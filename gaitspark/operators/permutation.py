"""Contrast of two sides with a permutation null; rows are shuffled a fixed number of times, however many permutations there are."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ranked, settled

#: Rows of a key that one task takes.
MOST = 1_000_000
#: Larger keys that are searched together.
TOGETHER = 16
#: Binary digits a pass settles.
DIGITS = 8


def draw(b: int, j: np.ndarray) -> np.ndarray:
    """hierarchy.mixed_hash of permutation b and row numbers."""
    m = 2147483647
    x = ((b * 48271 + j * 69621 + 12345) % m) * 16807 % m
    y = (x % 46337) * (x // 46337 + 1) % m
    return (y * 48271 % m) // 7


def place(b: int, j: np.ndarray, bits: int) -> np.ndarray:
    """Where rows stand in permutation b: by their draws, equal ones by row number of at most so many bits."""
    return (draw(b, j) << bits) | j


def median(v: np.ndarray) -> float | None:
    if not len(v):
        return None
    low, high = (len(v) - 1) // 2, len(v) // 2
    s = np.partition(v, (low, high))
    return 0.5 * float(s[low]) + 0.5 * float(s[high])


def _in_one_task(keys: list[str], shuffles: int):
    """Medians of both sides of one key, for the real sides (b = -1) and each permutation."""

    def run(table):
        import pyarrow as pa

        v, j, real = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_v", "_j", "_a"))
        n, n_a, rows = len(v), int(real.sum()), []
        bits = max(n - 1, 1).bit_length()
        for b in range(-1, shuffles):
            first = real.astype(bool)
            if b >= 0 and 0 < n_a < n:
                at = place(b, j, bits)
                first = at <= np.partition(at, n_a - 1)[n_a - 1]
            rows.append((median(v[first]), median(v[~first])))
        out = table.select(keys).take([0] * len(rows))
        for name, cells in (("b", range(-1, shuffles)), ("n_a", [n_a] * len(rows)), ("n_b", [n - n_a] * len(rows))):
            out = out.append_column(name, pa.array(list(cells), pa.int64()))
        for name, k in (("m_a", 0), ("m_b", 1)):
            out = out.append_column(name, pa.array([r[k] for r in rows], pa.float64()))
        return out

    return run


def _counted(table: DataFrame, search: dict, shift: int, bits: int, ends: dict) -> DataFrame:
    """(state, digit, n): rows of each state's key, permutation and side by the digit after the state's prefix.

    search: (key, b) -> list of (state, side, prefix). Side None counts places in the
    permutation; True and False count ranks of the rows that ends, the last place of the
    first side, puts on that side. A task counts in place and gives what isn't zero.
    """

    def run(batches):
        import pyarrow as pa

        top, counts = 1 << DIGITS, {}
        for batch in batches:
            keys, j, r, real = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_j", "_r", "_a"))
            for key in np.unique(keys).tolist():
                own = keys == key
                own_j, own_r, own_a = j[own], r[own], real[own].astype(bool)
                for b, states in ((b, s) for (g, b), s in search.items() if g == key):
                    if states[0][1] is None:
                        here, near = place(b, own_j, bits) >> shift, slice(None)
                    else:
                        digits = own_r >> shift
                        near = np.flatnonzero(np.isin(digits >> DIGITS, [p for _, _, p in states]))
                        here = digits[near]
                        first = own_a[near] if b < 0 else place(b, own_j[near], bits) <= ends[key, b]
                    for state, side, prefix in states:
                        fits = here >> DIGITS == prefix
                        if side is not None:
                            fits &= first == side
                        got = np.bincount(here[fits] & (top - 1), minlength=top)
                        counts[state] = counts[state] + got if state in counts else got
        for state, got in counts.items():
            digit = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digit), state)), pa.array(digit), pa.array(got[digit].astype(np.int64))], ["state", "digit", "n"])

    return table.mapInArrow(run, "state long, digit long, n long").groupBy("state", "digit").agg(F.sum("n").alias("n"))


def _search(table: DataFrame, wanted: list[tuple], width: int, bits: int, ends: dict) -> list[int]:
    """The number at position want (from 0) for each (key, b, side, want), digit by digit: a pass counts the next digits, the driver keeps one prefix a state.

    For places (side None) it is enough that no other place lies between it and the result.
    """
    prefix, want, found = [0] * len(wanted), [w for *_, w in wanted], [None] * len(wanted)
    shift = -(-width // DIGITS) * DIGITS
    while shift:
        shift -= DIGITS
        search: dict = {}
        for state, (key, b, side, _) in enumerate(wanted):
            if found[state] is None:
                search.setdefault((key, b), []).append((state, side, prefix[state]))
        if not search:
            break
        goal = table.sparkSession.createDataFrame([(s, want[s]) for s in range(len(wanted)) if found[s] is None], "state long, want long")
        run = _counted(table, search, shift, bits, ends).withColumn("upto", F.sum("n").over(W.partitionBy("state").orderBy("digit")))
        hit = run.join(F.broadcast(goal), "state").where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("n") <= F.col("want")))
        for row in hit.collect():  # one a state
            s = row["state"]
            want[s] -= row["upto"] - row["n"]
            prefix[s] = prefix[s] << DIGITS | row["digit"]
            if not shift or (wanted[s][2] is None and want[s] + 1 == row["n"]):
                found[s] = ((prefix[s] + 1) << shift) - 1
    return found


def _over_tasks(rows: DataFrame, sizes: list[tuple[int, int]], shuffles: int) -> list[tuple]:
    """(key's number, b, n_a, n_b, m_a, m_b) of keys that no task holds; rows: _g, _o, _v, _a, and sizes: n, n_a of each _g.

    Rows get two numbers within their key by two range sorts: _j in the given order and _r by
    value. A permutation's first side are the rows up to its n_a-th place; that place and the
    ranks of both sides' middle rows are searched for by counting digits.
    """
    starts = np.concatenate([[0], np.cumsum([n for n, _ in sizes])])[:-1].tolist()
    own = lambda: F.col("no") - F.get(F.lit(starts).cast("array<bigint>"), F.col("_g"))
    numbered = ranked(rows, "_g", "_o", "_v", "_a").select("_g", own().alias("_j"), "_v", "_a")
    table = settled(ranked(numbered, "_g", "_v", "_j").select("_g", "_j", own().alias("_r"), "_v", "_a"), "contrast")
    bits = max(max(n for n, _ in sizes) - 1, 1).bit_length()
    ends = {(g, b): -1 if not n_a else 1 << 62 for g, (n, n_a) in enumerate(sizes) for b in range(shuffles) if n_a in (0, n)}
    cuts = [(g, b, None, n_a - 1) for g, (n, n_a) in enumerate(sizes) for b in range(shuffles) if (g, b) not in ends]
    # A draw has 29 bits.
    ends |= {(g, b): end for (g, b, *_), end in zip(cuts, _search(table, cuts, 29 + bits, bits, {}), strict=True)}
    middle = []
    for g, (n, n_a) in enumerate(sizes):
        for side, m in ((True, n_a), (False, n - n_a)):
            middle += [(g, b, side, w) for b in range(-1, shuffles) for w in sorted({(m - 1) // 2, m // 2}) if m]
    at = _search(table, middle, bits, bits, ends)
    look = table.sparkSession.createDataFrame(sorted({(g, r) for (g, *_), r in zip(middle, at, strict=True)}), "_g int, _r long")
    value = {(r["_g"], r["_r"]): r["_v"] for r in table.join(F.broadcast(look), ["_g", "_r"]).select("_g", "_r", "_v").collect()}
    found: dict = {}
    for (g, b, side, _), r in zip(middle, at, strict=True):
        found.setdefault((g, b, side), []).append(value[g, r])
    mid = lambda s: None if s is None else 0.5 * s[0] + 0.5 * s[-1]
    return [(g, b, n_a, n - n_a, mid(found.get((g, b, True))), mid(found.get((g, b, False)))) for g, (n, n_a) in enumerate(sizes) for b in range(-1, shuffles)]


def permutation_contrast(rows: DataFrame, keys: list[str], value: str = "value", side: str = "side", order: str = "id", shuffles: int = 200, most: int = MOST) -> DataFrame:
    """A17 with arithmetic shuffles: medians, difference, null envelope and p of side a against all others, for each of keys.

    In a shuffle rows are ordered by a hash of (shuffle, row number) and the first n_a
    of them stand for side a; p = (nulls at least as extreme + 1) / (shuffles + 1). Rows without
    a value take no part; a null key is a key; NaN comes after all values; a key with one
    side only has null medians for the other, a null difference and the least p.

    rows are written once. A key of at most ``most`` rows is one group; of larger keys, whose
    number is bounded by the rows over most, no task ever holds one, see _over_tasks(). Both give the same.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), F.coalesce(F.col(side) == "a", F.lit(False)).alias("_a"))
    kept = settled(kept, "sides")
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_a").alias("n_a")).where(F.col("n") > most)
    large, spark = sizes.collect(), rows.sparkSession
    kinds = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, b long, n_a long, n_b long, m_a double, m_b double"

    def table_of(some):
        names = ", ".join(f"_k{i} {kept.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
        return F.broadcast(spark.createDataFrame([(g, *[r[k] for k in keys]) for g, r in enumerate(some)], f"_g int, {names}"))

    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    small = kept.join(table_of(large), same, "left_anti") if large else kept
    numbered = small.withColumn("_j", F.row_number().over(W.partitionBy(*keys).orderBy("_o", "_v", "_a")).cast("long") - 1)
    parts = numbered.select(*keys, "_j", "_v", "_a").groupBy(*keys).applyInArrow(_in_one_task(keys, shuffles), schema)
    for i in range(0, len(large), TOGETHER):
        some = large[i : i + TOGETHER]
        got = _over_tasks(kept.join(table_of(some), same).select("_g", "_o", "_v", "_a"), [(r["n"], r["n_a"]) for r in some], shuffles)
        parts = parts.union(spark.createDataFrame([(*[some[g][k] for k in keys], *rest) for g, *rest in got], schema))
    real, d = F.col("b") < 0, F.col("m_a") - F.col("m_b")
    null = F.when(~real, d)
    out = parts.groupBy(*keys).agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(F.when(real, F.col("m_a"))).alias("median_a"), F.max(F.when(real, F.col("m_b"))).alias("median_b"), F.max(F.when(real, d)).alias("diff"),
        F.percentile(null, 0.025).alias("null_lo"), F.percentile(null, 0.975).alias("null_hi"), F.collect_list(F.abs(null)).alias("_far"),
    )
    extreme = F.size(F.filter("_far", lambda x: x >= F.abs("diff") - 1e-12))
    return out.withColumn("p_perm", (extreme + 1) / (shuffles + 1)).drop("_far")
