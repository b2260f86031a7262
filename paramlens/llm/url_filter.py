"""URL filters with redirect equivalence.

Rules fit a host with its subdomains and a path prefix; the longest fitting rule decides. A url
that no rule fits takes the decision of its aliases: urls tied to it by redirects, canonical
links or a common canonical form are found as connected components, and a block of any of them
holds for all, unless one of them is explicitly allowed, which goes before. Without either, a
url is allowed.

Targets of canonical links and refreshes are resolved against the page's ``<base>`` or url:
relative paths, dot segments, queries, fragments and targets without a scheme. Those of schemes
without ``//``, such as ``mailto:``, are no urls.

Null urls and urls without ``://`` have an empty host and path, fit no rule and have no aliases,
so they are allowed. Repeated pages are judged one by one; pages of one url are one node. Null
html has no targets; very long urls and html are read whole. Of equally long rules that fit, the
later by code point wins. An empty table gives an empty one. The caller's columns stay, except
that ``host``, ``path``, ``rule`` and ``verdict`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, looked_up
from .components import components

ALLOW, BLOCK = "allow", "block"
#: Lists up to this length become one expression; longer ones are joined.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    """``host/path``; the path may be empty."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    Rule(ALLOW, "com/"),
    Rule(BLOCK, "example.com/en/"),
    Rule(ALLOW, "www.example.com/en/"),
    Rule(BLOCK, "net/es/"),
    Rule(BLOCK, "net/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``, null where no rule fits. Needs ``host`` and ``path``."""
    if len(rules) > INLINE_RULES:
        return _joined(pages, rules)
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found, verdict = F.when(fits, F.lit(r.pattern)).otherwise(found), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumns({"rule": found, "rule_verdict": verdict})


def _joined(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same by equality: every host suffix with every path prefix of a length that rules have."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.pattern, r.verdict) for r in rules], "_host string, _path string, rule string, rule_verdict string")
    lengths = F.array(*[F.lit(n) for n in sorted({len(r.path) for r in rules})])
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.withColumn("_host", F.explode(suffixes)).withColumn("_n", F.explode(lengths))
    tried = tried.where(F.length("path") >= F.col("_n")).withColumn("_path", F.substring(F.col("path"), F.lit(1), F.col("_n")))
    best = tried.join(listed, ["_host", "_path"]).groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("_best")
    )
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.rule_verdict")}).drop("_best")


def canonical(url: Column) -> Column:
    """A url without scheme, ``www.``, fragment, tracking parameters, ``.html`` and closing slash."""
    rest = F.regexp_replace(F.regexp_extract(url, r"://([^#]*)", 1), r"(?<=[?&])(?:utm_[a-z]+|ref)=[^&]*&?", "")
    rest = F.regexp_replace(rest, r"[?&]+$", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), _UPPER, _LOWER), r"^www\.", "")
    tail = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"(?:\.html?|/)$", "")
    return F.concat(host, tail, F.regexp_extract(rest, r"(\?.*)$", 1))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, with ``.`` and ``..`` carried out."""
    parts = F.split(path, "/")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    closing = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(closing, F.lit("/")).otherwise(F.lit("")))


def resolved(target: Column, base: Column) -> Column:
    """A target as a whole url; null where it is none. Whole urls stay as they are."""
    root, path = F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*", 0), path_of(base)
    own, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(?s:.*)/", 0), F.lit("")), F.lit("/"))
    return (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when((target == "") | F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^((?s:.*?):)//", 1), target))
        .when(target.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), target))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), rest))
    )


def _decoded(target: Column) -> Column:
    return F.regexp_replace(target, r"(?i)&(?:amp|#0*38|#x0*26);", "&")


def aliases(pages: DataFrame) -> DataFrame:
    """Edges (url, alias) between nodes: the canonical form, canonical links and page redirects."""
    tag = r"(?is)<{}\b[^>]*>"
    link = F.filter(F.regexp_extract_all("html", F.lit(tag.format("link")), F.lit(0)), lambda t: F.rlike(t, F.lit(r"(?i)rel\s*=\s*[\"']?canonical")))
    move = F.filter(F.regexp_extract_all("html", F.lit(tag.format("meta")), F.lit(0)), lambda t: F.rlike(t, F.lit(r"(?i)http-equiv\s*=\s*[\"']?refresh")))
    href = r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"
    there = F.concat(
        F.transform(link, lambda t: F.regexp_extract(t, href, 1)),
        F.transform(move, lambda t: F.regexp_extract(t, r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    based = F.regexp_extract("html", tag.format("base"), 0)
    heads = pages.where(F.col("url").contains("://")).select("url", there.alias("targets"), based.alias("base"))
    found = heads.where(F.size("targets") > 0).select("url", "base", F.explode("targets").alias("target"))
    base = F.coalesce(resolved(_decoded(F.regexp_extract("base", href, 1)), F.col("url")), "url")
    found = found.select("url", base.alias("base"), _decoded(F.col("target")).alias("target"))
    told = found.select("url", resolved(F.col("target"), F.col("base")).alias("alias")).where(F.col("alias").isNotNull())
    forms = heads.select("url").unionByName(told.select(F.col("alias").alias("url")))
    forms = forms.distinct().withColumn("alias", F.concat(F.lit("="), canonical(F.col("url"))))
    return told.unionByName(forms)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``.

    ``redirects``, if given, has (url, alias) rows from a crawl log. Its urls need no page; rules
    decide for them as well, and what they decide spreads too.
    """
    edges = aliases(pages)
    if redirects is not None:
        more = redirects.select("url", "alias").where(F.col("url").contains("://") & F.col("alias").contains("://"))
        ends = more.select("url").unionByName(more.select(F.col("alias").alias("url"))).distinct()
        edges = edges.unionByName(more).unionByName(ends.withColumn("alias", F.concat(F.lit("="), canonical(F.col("url")))))
    groups = components(edges, "url", "alias")
    members = groups.where(~F.col("node").startswith("=")).withColumnRenamed("node", "url")
    ruled = matched(members.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    decided = ruled.groupBy("component").agg(
        F.bool_or(F.col("rule_verdict") == ALLOW).alias("allows"), F.bool_or(F.col("rule_verdict") == BLOCK).alias("blocks")
    )
    spread = members.join(decided.where(F.coalesce("blocks", F.lit(False)) & ~F.coalesce("allows", F.lit(False))), "component")
    spread = spread.select("url", F.lit(BLOCK).alias("spread"))
    # Only blocked urls are looked up, and the pages of a rule need no look.
    own = pages.select(*[F.col(c).alias(f"_page_{c}") for c in pages.columns], "url")
    own = matched(own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    asks = F.when(F.col("rule").isNull() & F.col("url").contains("://"), F.col("url"))
    out = looked_up(own.withColumn("url", asks), Written(spread).df, "url")
    verdict = F.coalesce("rule_verdict", "spread", F.lit(ALLOW)).alias("verdict")
    kept = [F.col(f"_page_{c}").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, "host", "path", "rule", verdict)


def digest_row(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return judge(pages.select("page_id", "url", "html"), rules).select("page_id", "host", "path", "rule", "verdict")
