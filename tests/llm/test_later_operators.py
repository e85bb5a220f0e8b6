"""Operators 11 to 13 against brute force, with the awkward rows each must take."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.llm import codes, later_queries, licenses, tries

from ..oracle import DATA, compare

rng = random.Random(5)


@pytest.mark.parametrize("name", sorted(later_queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    compare(spark, name, later_queries.QUERIES[name], later_queries.ORACLE_SQL[name], DATA)


# --- 11 tries -------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += worth
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df, most=tries.MOST):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in tries.prefix_trie(df, most).select(*names).collect()), key=str)


def conversations(seed, convs, deep=6, words=3):
    r, rows = random.Random(seed), []
    for c in convs:
        for turn in range(r.randint(1, deep)):
            rows.append((c, turn, r.choice(["user", "assistant"]), " ".join(r.choice("ab") for _ in range(r.randint(1, words)))))
    return rows


@pytest.mark.parametrize("most", [tries.MOST, 1, 7])
def test_trie_matches_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 4)
    rows = conversations(1, [c for c in range(-45, 140) if c % 3 or c % 20 == 0])
    assert trie_rows(spark.createDataFrame(rows, TURNS).repartition(5), most) == brute_trie(rows)


@pytest.mark.parametrize("most", [tries.MOST, 50])
def test_deep_copies_over_families(spark, most):
    """Long conversations that several families share: their sums climb over many levels."""
    line = [(turn, "user", f"turn {turn}") for turn in range(130)]
    rows = [(c, *t) for c in (0, 20, 40, 61, 83) for t in line[: 130 - c]]
    rows += [(100, *t) for t in line[:90]] + [(100, 200, "user", "another end")]
    assert trie_rows(spark.createDataFrame(rows, TURNS), most) == brute_trie(rows)


def test_trie_of_awkward_rows(spark):
    long = " ".join("w" for _ in range(50_000))
    rows = [
        (None, 1, "user", "lost"), (3, None, None, None), (3, 1, "user", long), (3, 1, "user", long), (3, 1, "assistant", ""), (4, 2, "", None), (5, 2, None, ""),
        (40, 1, "a", "b:c"), (60, 1, "a:b", "c"), (7, 0, "user", "x"), (9, None, "user", "x"), (2**40, 5, "user", "\x1c \x0b z"), (0, 1, "user", "of the base"),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("key", "parent", "family", "hash", "words", "depth")})
    assert trie_rows(df) == brute_trie(rows)
    assert trie_rows(spark.createDataFrame([], TURNS)) == []


def test_common_opening_is_one_row_a_family(spark):
    """All conversations begin alike: each family sends one row for the opening, whatever its size."""
    rows = [(c, t, "user", "same opening" if t < 3 else f"{c}") for c in range(400) for t in range(4)]
    nodes = tries.family_nodes(spark.createDataFrame(rows, TURNS))
    assert nodes.where("depth <= 3").groupBy("key").count().agg(F.max("count")).first()[0] == 20


# --- 12 codes -------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    width = len(kept[0][1])
    kept = [x for x in kept if len(x[1]) == width]
    ints = [[codes._whole(float(np.float32(x))) for x in v] for _, v, _ in kept]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in ints]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, f in zip(ints, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    error = [min(sum(d for d, _ in f), codes.LONG) for f in found]
    total = defaultdict(int)
    for (_, _, lab), e in zip(kept, error, strict=True):
        total[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for _, x in f), e, min(total[lab], codes.LONG)) for (i, _, lab), f, e in zip(kept, found, error, strict=True)), key=str), digest


def coded_rows(df, **k):
    out, books = codes.compress(df, **k)
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str), codes.codebooks_digest(books)


def test_codes_match_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=8) * r.choice([0.01, 1, 3])).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(150)]
    rows += [(i, [float(round(x)) for x in r.normal(size=8)], 1) for i in range(150, 220)]  # many ties
    rows += [(None, [0.5] * 8, None), (3, rows[3][1], 0), (3, [1.0] * 8, 0), (900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (904, [1.0] * 4, 1), (905, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({c: F.lit("x") for c in ("vector", "code", "error", "_label", "part", "_0")})
    assert coded_rows(df, entries=20, rounds=4) == brute_codes(rows, 4, 20, 4)


def test_codes_of_large_components(spark):
    rows = [(i, [float(np.float32(x)) for x in (8e37 * (i % 5), 3.0, -2.5e30, i)], 0) for i in range(30)] + [(40, [-3e38, 1.0, 1.0, 1.0], 0)]
    assert coded_rows(spark.createDataFrame(rows, VECTORS), entries=4, rounds=2) == brute_codes(rows, 4, 4, 2)


def test_codes_of_nothing(spark):
    assert coded_rows(spark.createDataFrame([], VECTORS))[0] == []
    assert coded_rows(spark.createDataFrame([(1, None, 1)], VECTORS))[0] == []
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS))


@pytest.mark.parametrize("spread, most", [(3.0, 0.6), (0.0, 1.0)])
def test_annulus_is_exact_and_prunes(spread, most):
    """Where norms differ only the annulus is measured; entries on its edge belong to it."""
    r = np.random.default_rng(4)
    scale = np.exp(spread * r.normal(size=(600, 1)))
    x = np.floor(r.normal(size=(600, 6)) * 1000 * scale).astype(np.int64)
    book = codes.Codebook(x[:256])
    index, dist, measured = book.nearest(x)
    d = ((x[:, None, :] - x[None, :256, :]) ** 2).sum(2)
    assert (dist == d.min(1)).all() and (index == d.argmin(1)).all()
    assert measured <= most * d.size
    line = codes.Codebook(np.array([[0, 0], [4, 0], [0, 2], [2, 0], [-2, 0], [2, 0]]))
    assert line.nearest(np.array([[1, 0], [3, 0], [0, 0], [0, 1]]))[0].tolist() == [0, 1, 0, 0]


def test_codes_decode(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist(), 0) for i in range(60)]
    out, books = codes.compress(spark.createDataFrame(rows, VECTORS), entries=60, rounds=1)
    got = {x["vec_id"]: x["vector"] for x in codes.decode(out, books).collect()}
    assert max(abs(a - b) for i, v, _ in rows for a, b in zip(v, got[i], strict=True)) < 2 / codes.SCALE


# --- 13 licences ----------------------------------------------------------------

DOCS = "doc_id long, text string"


def brute_scan(text, phrases, notices, percent):
    words = licenses.words_of(text or "")
    places = []
    for phrase, label in phrases:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if at:
            places.append((label, phrase, len(at), at[0], at[-1]))
    templates, best = licenses.templates_of(notices, percent), {}
    above = set(licenses.covers(templates))
    for stride in {t.stride for t in templates}:
        for at in range(0, len(words), stride):
            block = set(words[at : at + 2 * stride])
            met = [t for t in templates if t.stride == stride and len(block & set(t.words)) >= t.need and set(t.names) <= block]
            for t in met:
                if not any((t.number, o.number) in above for o in met):
                    share, start = best.get(t.label, (0, at))
                    best[t.label] = (max(share, len(block & set(t.words)) / len(t.words)), min(start, at))
    return len(words), places, [(k, *v) for k, v in sorted(best.items())]


def scanned(df, *args):
    tuples = lambda xs: [tuple(x) for x in xs]
    return [(r["doc_id"], r["n_words"], tuples(r["places"]), tuples(r["notices"])) for r in licenses.scan_licenses(df, *args).collect()]


NOISE = ["der", "the", "license", "under", "mit", "version", "2", "cc", "by", "nc", "work", "gnu", "general", "public", "is", "a", "zwei", "éa", "X", "apache"]


def license_texts():
    texts = [None, "", " .,; ", "MIT", "under the MIT-License under the mit license", "É CC-BY/NC, cc by nc\ncc BY nc"]
    for label, _, text in licenses.TEMPLATES:
        around = lambda n: " ".join(rng.choice(NOISE) for _ in range(n))
        texts += [text, f"{around(rng.randint(0, 90))}\n{text} {around(40)}", text.upper().replace(" ", "\n")]
        words = text.split()
        for drop in (1, 2, len(words) // 4):
            cut = words[:]
            for _ in range(drop):
                cut[rng.randrange(len(cut))] = rng.choice(["zzz", "the", "9"])
            texts.append(f"{around(25)} {' '.join(cut)} {around(70)}")
    texts += [" ".join(rng.choice(NOISE) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts.append(" ".join(rng.choice(NOISE) for _ in range(30_000)) + " This work is licensed under the GNU General Public License, version 3.")
    return texts


@pytest.mark.parametrize("percent", [80, 100, 60])
def test_scan_matches_brute_force(spark, percent):
    texts = license_texts()
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(1, texts[7]), (1, texts[7]), (None, texts[7])]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    extra = df.withColumns({c: F.lit("x") for c in ("places", "notices", "n_words", "a", "b", "w", "block", "label", "pos")})
    want = sorted(((i, *brute_scan(t, licenses.PHRASES, licenses.TEMPLATES, percent)) for i, t in rows), key=str)
    assert sorted(scanned(extra, licenses.PHRASES, licenses.TEMPLATES, percent), key=str) == want


def test_phrases_that_overlap_themselves(spark):
    df = spark.createDataFrame([(1, "a b a b a x a.b,a"), (2, "ab a b"), (3, None)], DOCS)
    got = {r[0]: r[2] for r in scanned(df, [("a b a", "x"), ("c+", "y")], [("z", "zeta", "zeta eta theta")])}
    assert got == {1: [("x", "a b a", 3, 0, 6)], 2: [], 3: []}


def test_scan_of_nothing(spark):
    assert scanned(spark.createDataFrame([], DOCS)) == []
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark.createDataFrame([], DOCS), [])


def test_main_path_is_native(spark):
    plan = licenses.scan_licenses(spark.createDataFrame([(1, "x")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_planted_lines_are_found_and_others_left_alone(spark):
    """Each license line of the given documents gets its label, and no other document has one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wanted = {"released under the mit license": "mit", "licensed under cc by-nc 4.0": "cc-by-nc", "apache license, version 2.0": "apache-2", "gnu general public license, version 3": "gpl-3"}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in later_queries.QUERIES["op13_license_notices"](spark, DATA).collect():
        text = (texts[r["doc_id"]] or "").lower()
        assert r["labels"] == ",".join(sorted(v for k, v in wanted.items() if k in text)), r
        assert (r["score"] > 0) == bool(r["labels"])
