from urllib.parse import urljoin

from gaitspark.llm import queries, urls

from ..oracle import compare

TARGETS = ["page2.html", "../x", "../../../x", "./", "..", ".", "a/./b/../c?q=/../1", "?id=3", "/r/../s", "/", "..x/y", "//other.org/z", "http://abs.org/k", "f?u=http://w.org/v"]
BASES = ["https://a.org/d/e/f.html?x=1", "https://a.org/", "https://a.org", "http://a.org/g/"]


def linked(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")


def test_relative_links_are_resolved(spark):
    rows = [(b, f'<link rel="canonical" href="{t}">') for b in BASES for t in TARGETS] + [(b, f'<meta http-equiv="refresh" content="0; url={t}">') for b in BASES for t in TARGETS]
    want = {(b, urljoin(b, t)) for b in BASES for t in TARGETS}
    got = {(r["u"], r["v"]) for r in urls.alias_links(linked(spark, rows)).collect()}
    assert got == {(u, v) for u, v in want if u != v}
    # Empty segments, which urljoin drops, and an address in upper case.
    rows = [("HTTPS://A.org/g//h", f'<link rel="canonical" href="{t}">') for t in ("../x", "d//e")]
    assert {(r["u"], r["v"]) for r in urls.alias_links(linked(spark, rows)).collect()} == {("https://a.org/g//h", "https://a.org/g/x"), ("https://a.org/g//h", "https://a.org/g//d//e")}
    none = [("https://a.org/b", f'<link rel="canonical" href="{t}">') for t in ("#top", "mailto:x@y.org", "javascript:void(0)")] + [("no scheme", '<link rel="canonical" href="x">'), (None, '<link rel="canonical" href="x">')]
    assert urls.alias_links(linked(spark, none)).count() == 0


def test_canonical_anywhere_in_rel(spark):
    rels = ['"alternate canonical"', "'nofollow\ncanonical'", '"canonical alternate"', "canonical", '"a canonical b"']
    rows = [("https://a.org/b", f'<link rel={r} href="c{i}">') for i, r in enumerate(rels)] + [("https://a.org/b", '<link rel="alternate" title="canonical" href="no">'), ("https://a.org/b", '<link rel="noncanonical" href="no">')]
    assert {r["v"] for r in urls.alias_links(linked(spark, rows)).collect()} == {f"https://a.org/c{i}" for i in range(5)}


def test_decisions_follow_relative_links(spark):
    rows = [("https://a.org/p/1", '<link rel="canonical" href="2">'), ("https://a.org/p/2", '<link rel="alternate canonical" href="../q?id=3">'), ("https://a.org/q?id=3", '<meta http-equiv=refresh content="0;url=https://bad.net/">'), ("https://a.org/r", "")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(linked(spark, rows), queries.RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow"}


BAD = '<link rel="canonical" href="https://bad.net/">'
INERT = [
    f"<!-- {BAD} -->", f"<!-- {BAD}", f'<script>var x = "{BAD}";</script>', f"<SCRIPT type='a>b'> {BAD} </Script >", f"<style>{BAD}</style>", f"<template>{BAD}</template>", f"<textarea>{BAD}", f"<title>{BAD}</title>",
    f"<a title='{BAD}'>x</a>", f'<!-- a --><!-- <base href="https://bad.net/x/"> --><link rel=canonical href="0">', "<script></script><link-x rel=canonical href=https://bad.net/>",
]
LIVE = [f"<!-- a -->{BAD}", f"<title-x>{BAD}", f"<script src=x></script>{BAD}", f"<noscript>{BAD}</noscript>", f"<p a='>'>{BAD}", f"<title></title>{BAD}<!--"]


def test_what_is_no_tag_links_nothing(spark):
    """Comments, scripts and values of other tags hold no links, and what follows them does."""
    pages = linked(spark, [(f"https://c.org/{i}", html) for i, html in enumerate([*INERT, *LIVE])])
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, queries.RULES).collect()}
    assert [got[i] for i in range(len(got))] == ["allow"] * len(INERT) + ["block"] * len(LIVE)


def test_long_and_open_tags(spark):
    long = "a" * 200_000
    rows = [("https://l.org/1", f"<link data-x={long} rel=canonical href=https://bad.net/>"), ("https://l.org/2", f"<p {long} {BAD}"), ("https://l.org/3", "<p " * 20_000 + BAD), ("https://l.org/4", f"<div x='{long}'>" + BAD)]
    got = {r["u"] for r in urls.alias_links(linked(spark, rows)).collect()}
    assert {"https://l.org/1", "https://l.org/4"} <= got


def chained(spark):
    """Pages with chains of canonical links and redirects of all forms, to allowed, blocked and unknown ends."""
    rows = []
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel='alternate canonical'>", "<link rel=canonical href={}>", '<meta http-equiv="refresh" content="0; url={}">', "<meta content='3;URL={}' http-equiv=Refresh>", '<meta http-equiv=refresh content="0;url=\'{}\'">', '<link title="a > b" rel="x canonical" href=" {} ">']
    ends = ["https://bad.net/x", "https://example.net/en/ok", "https://site.org/plain", "http://sub.example.com/de/q"]
    for c in range(24):
        host = f"https://h{c}.org"
        for i in range(5):
            to = [f"{i + 1}.html", f"./{i + 1}.html", f"/d/{i + 1}.html", f"../d/./{i + 1}.html", f"{host}/d/{i + 1}.html#top"][(c + i) % 5] if i < 4 else ends[c % 4]
            rows.append((f"{host}/d/{i}.html", f"<head>{forms[(c * 3 + i) % 7].format(to)}</head>"))
    rows += [
        ("https://b.org/p/1", '<base target="_top"><base href="https://bad.net/q/"><link rel=canonical href="z">'), ("https://b.org/p/2", '<base href="/r/"><link rel=canonical href="z?a=1&amp;b=2">'), ("https://b.org/r/z?a=1&b=2", '<link rel=canonical href="//bad.net/">'),
        ("https://b.org/p/3", '<base href="mailto:x"><link rel=canonical href="1">'), ("https://b.org/p/4", '<link rel=canonical data-href="https://bad.net/" href="?q=1">'), ("https://b.org/p/4?q=1", '<meta http-equiv=refresh content="5">'),
        ("https://b.org/p/5", '<link rel="canonical" href="a b/../c d">'), ("https://b.org/p/c d", '<link rel="canonical" href="https://bad.net/y">'), ("https://b.org", '<link rel="canonical" href="..">'), *((f"https://c.org/{i}", html) for i, html in enumerate(INERT)), (None, None), ("x", "canonical"), ("https://example.net/en/ok", None), ("https://BAD.net/x", ""),
    ]
    return linked(spark, rows)


def test_chains_match_the_sql(spark, tmp_path):
    chained(spark).write.parquet(f"{tmp_path}/pages.parquet")
    compare_links(spark, str(tmp_path))
    got = {r["page_id"]: r["verdict"] for r in queries.op3_redirect_equivalence(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(20)] == ["block"] * 5 + ["allow"] * 10 + ["block"] * 5
    assert [got[i] for i in range(120, 128)] == ["block", "block", "block", "block", "allow", "allow", "block", "block"]


def compare_links(spark, d):
    import os

    os.rename(f"{d}/pages.parquet", f"{d}/parts")
    spark.read.parquet(f"{d}/parts").toPandas().to_parquet(f"{d}/pages.parquet")
    compare(spark, "op3", queries.QUERIES["op3_redirect_equivalence"], queries.ORACLE_SQL["op3_redirect_equivalence"], d)
