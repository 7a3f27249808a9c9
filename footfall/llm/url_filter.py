"""URL filters: rules for hosts and paths, and decisions that follow redirects.

A url's node is the url without fragment, scheme and host in lower case. Canonical links and `refresh` redirects found
in the pages' markup, and a table of redirects where there is one, are edges. Urls connected by edges are aliases of
each other: where a rule blocks one of them, all aliases without a rule of their own are blocked too. An explicit
rule for a url always stands, so an allowed url stays allowed among blocked aliases, and only block decisions spread.

Hosts and rules are worked out by SQL functions. Markup is parsed in Arrow batches, and only for pages that name a
canonical link or a refresh at all. Components are computed on stored tables of edges (`components`); pages meet their
decision by an equi-join on the url, whose other side has each url once.

Defined results: null urls and such without `://` have an empty host and path, no rule and no aliases, and are
allowed. Null or empty markup has no links. Every row of the pages gets one row, repeated rows and null ids too;
further columns of the pages are left out. Links that do not resolve to a url with `://` are no edges. An empty table
gives no rows. Very long urls and pages are worked through whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stored
from footfall.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str  # "block" or "allow"
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url without fragment, its scheme and host in lower case; null where there is no `://`."""
    at = F.instr(url, "://")
    scheme = F.translate(F.substring(url, F.lit(1), at + 2), UPPER, LOWER)
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(at > 0, F.concat(scheme, host_of(url), rest))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as (name, verdict), else null; of equally long ones allow stands before block.

    The rules are part of the plan, which is meant for lists of up to some hundreds.
    """
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for r in sorted(set(rules), key=lambda r: (len(r.name), r.verdict == "allow", r)):  # the last one wins
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


class _Links(HTMLParser):
    """Targets of canonical links of the head and of refresh redirects, resolved against the page's base."""

    def __init__(self, url: str):
        super().__init__()
        self.base, self.found, self.head = url, [], True

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}  # the first of equal attributes counts
        if tag == "body":
            self.head = False
        elif tag == "base" and "href" in a:
            self.base = self._resolved(a["href"]) or self.base
        elif tag == "link" and self.head and "canonical" in a.get("rel", "").lower().split():
            self.found.append(self._resolved(a.get("href", "")))
        elif tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            _, _, target = a.get("content", "").replace(",", ";", 1).partition(";")
            key, is_set, value = target.partition("=")
            if is_set and key.strip().lower() == "url":
                self.found.append(self._resolved(value.strip().strip("'\"")))

    def _resolved(self, target: str) -> str | None:
        try:
            return urljoin(self.base, target.strip()) if target.strip() else None
        except ValueError:  # a host that is no host
            return None


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, targets = [], []
        for url, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            parser = _Links(url)
            try:
                parser.feed(html)
                parser.close()
            except AssertionError:  # a declaration the parser does not know; links before it count
                pass
            for t in parser.found:
                if t and "://" in t:
                    urls.append(url)
                    targets.append(t)
        yield pa.RecordBatch.from_pydict({"url": pa.array(urls, pa.string()), "target": pa.array(targets, pa.string())})


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical links and refresh redirects in the pages' markup."""
    named = pages.where(F.col("url").contains("://") & F.lower("html").rlike("canonical|refresh"))
    return named.select("url", "html").mapInArrow(_links, "url STRING, target STRING")


def blocked_aliases(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(node): urls among the links without a rule of their own that a chain of links connects with a blocked url."""
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    edges = stored(edges.where("a <> b").distinct(), "redirects")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"))
    rule = best_rule(host_of(F.col("v")), path_of(F.col("v")), rules)["verdict"]
    judged = stored(components(edges).withColumn("verdict", rule), "aliases")
    bad = judged.where("verdict = 'block'").select("c").distinct()
    return judged.where("verdict IS NULL").join(bad, "c").select(F.col("v").alias("node"))


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; `redirects` has rows (url, target) seen by a crawler."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    spread = blocked_aliases(links, rules)
    url = F.col("url")
    found = pages.select("page_id", node_of(url).alias("_node"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = found.withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    found = found.join(spread.withColumnRenamed("node", "_bad"), F.col("_node") == F.col("_bad"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_bad").isNotNull(), "block"), F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"))
