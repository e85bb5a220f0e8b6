"""URL filter with redirect equivalence, in DataFrame operations alone.

Pages that redirect to one another, or name a canonical address, are aliases.
Connected components over these links carry a block decision to every alias; an
explicit allow among the aliases comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join
from .graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Behind the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ?, # or the end; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What tells pages apart: the url without its fragment, scheme and host lower-cased; null without ://."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path_of(url), query))


def clean_path(path: Column) -> Column:
    """A path that starts with / without its . and .. segments (RFC 3986, 5.2.4); .. at the root is dropped."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part))),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, folder), "/"))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not, with &amp; as &, without blanks around it; null without it."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    bare = F.regexp_replace(found, r"(?s)^([\"'])(.*)\1$", "$2")
    return F.nullif(F.trim(F.replace(F.regexp_replace(bare, r"[\t\r\n\f]", " "), F.lit("&amp;"), F.lit("&"))), F.lit(""))


def resolved(rows: DataFrame, base: str, link: str, out: str) -> DataFrame:
    """rows with column out: link resolved against the url in base (RFC 3986, 5.2); null for links with a scheme but no :// (mailto:)."""
    # One step at a time, so that no generated method outgrows the JVM's limit.
    rows = rows.withColumns({"_scheme": F.regexp_extract(base, r"(?s)^(.*?)://", 1), "_host": host_of(F.col(base)), "_path": path_of(F.col(base))})
    to = F.col(link)
    # The path of a link to a path; that of the base up to its last / comes before relative ones.
    folder = F.when(to.startswith("/"), "").when(F.instr("_path", "/") > 0, F.regexp_extract("_path", r"(?s)^.*/", 0)).otherwise("/")
    rows = rows.withColumns({"_to": F.concat(folder, F.regexp_extract(to, r"^[^?#]*", 0)), "_rest": F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)})
    root = F.concat("_scheme", F.lit("://"), "_host")
    whole = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat("_scheme", F.lit(":"), to))
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("#"), address_of(F.col(base)))
        .when(to.startswith("?"), F.concat(root, "_path", to))
        .otherwise(F.concat(root, clean_path(F.col("_to")), "_rest"))
    )
    return rows.withColumn(out, whole).drop("_scheme", "_host", "_path", "_to", "_rest")


#: Elements whose content is text, or stands for nothing until a script takes it.
INERT = ("script", "style", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes")


def tag_pattern(quote: str = "'", once: str = "+") -> str:
    """A regular expression that walks a page from tag to tag, with its links, metas and bases as group 1.

    Comments and inert elements are one step each, to their end or the page's, and so is any other
    tag with its quoted values, so that nothing in them counts as a tag. quote: how the
    language around writes a single quote; once: + or ++, where engines go back over what they took.
    """
    body = f'(?:"[^"]*"|{quote}[^{quote}]*{quote}|[^{quote}">]{once})*>'
    inert = "|".join(rf"<{e}(?:[\s/]{body}|>).*?(?:</{e}|\z)" for e in INERT)
    return rf"(?is)<!--.*?(?:-->|\z)|{inert}|(<(?:link|meta|base)[\s/]{body})|<[a-z/]{body}"


def alias_links(pages: DataFrame) -> DataFrame:
    """(u, v): addresses joined by a canonical link or a refresh redirect in the page's html.

    What stands in comments, scripts, styles, templates and text, or in a quoted value of
    another tag, is no link.

    Pages without either give no row. canonical may stand anywhere in rel. Relative
    links are resolved against the href of the first <base> that has one, itself
    resolved against the page's url, or against that url; those with a scheme but no
    :// (mailto:) are left out, and such a base counts as none.
    """
    html, tag = F.col("html"), F.col("tag")
    pages = pages.select("url", "html").where(html.rlike("(?i)canonical|http-equiv") & (F.instr("url", "://") > 0))
    pages = pages.select("url", F.filter(F.regexp_extract_all(html, F.lit(tag_pattern(once="++")), F.lit(1)), lambda t: t != "").alias("tags"))
    is_base = lambda t: t.rlike(r"(?i)^<base")
    hrefs = F.filter(F.transform(F.filter("tags", is_base), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    tags = pages.select("url", F.get(hrefs, F.lit(0)).alias("base"), F.explode(F.filter("tags", lambda t: ~is_base(t))).alias("tag"))
    canonical = F.when(tag.rlike(r"(?i)^<link") & attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), attribute(tag, "href"))
    content = F.regexp_extract(attribute(tag, "content"), r"(?is)(?:^|[;,\s])url\s*=\s*[\"']?([^\"']*)", 1)
    refresh = F.when(tag.rlike(r"(?i)^<meta") & attribute(tag, "http-equiv").rlike(r"(?i)^refresh$"), F.trim(content))
    # Few pages link at all; written between the steps, so that their expressions don't multiply.
    found = materialize(tags.select("url", "base", F.coalesce(canonical, refresh).alias("link")).where("link <> ''"), "linking")
    found = materialize(resolved(found, "url", "base", "from"), "based").withColumn("from", F.when(F.instr("from", "://") > 0, F.col("from")).otherwise(F.col("url")))
    found = resolved(found, "from", "link", "whole").select(address_of(F.col("url")).alias("u"), address_of(F.col("whole")).alias("v"))
    return found.where("u is not null and v is not null and u <> v")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(size, allow, rule), or null. rules: (allow or block, host and path).

    A rule fits its host and all subdomains if the path starts with the rule's. Of two
    equal rules allow wins. The list is a constant of the plan, for up to a few
    thousand rules.
    """
    fits = []
    for verdict, rule in rules:
        at, slash, start = rule.partition("/")
        fit = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(rule).alias("rule"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row of pages.

    A page with a rule gets the rule's verdict. Any other page gets allow if a rule
    allows one of its aliases, else block if a rule blocks one, else allow. Null urls
    and those without :// have empty host and path, no aliases and are allowed.
    Repeated rows are judged alike; other columns are left out.
    """
    pages = pages.select("page_id", "url", "html")
    links = materialize(alias_links(pages), "aliases")
    groups = materialize(components(links, "u", "v"), "components")
    judged = groups.withColumn("fit", rule_for(host_of(F.col("node")), path_of(F.col("node")), rules))
    known = judged.groupBy("component").agg(F.max("fit.allow").alias("component_allow"), F.count("*").alias("n")).where("component_allow is not null")
    known = spread_join(groups, known, "component", "n", groups.count()).select(F.col("node").alias("address"), "component_allow")
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("address"))
    out = out.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    # Rows without an address have no key to be joined by.
    none = out.where("address is null").withColumn("component_allow", F.lit(None).cast("boolean"))
    out = out.where("address is not null").join(known, "address", "left").unionByName(none)
    allow = F.coalesce("fit.allow", "component_allow", F.lit(True))
    return out.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))
