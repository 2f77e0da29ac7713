"""URL filters: explicit rules first, then the reputation of hosts by empirical Bayes.

A rule names a host and the beginning of a path; it fits its host and all subdomains, and the longest that fits decides. What no rule
decides goes by labelled outcomes of pages (1: bad): counts by host are shrunk through beta-binomial priors from suffix to registered
domain to host. Each level's prior has the posterior mean of the level above as its mean, and a strength fitted by moments from how far the
level's groups scatter around it. A host is blocked if the lower bound of its posterior (mean - Z standard deviations) lies over a limit,
so hosts with few labels go by their domain, and domains with few by their suffix.

Counts combine before they are shuffled, and the levels are tables of hosts, domains and suffixes; a hot host's pages are only joined with
one row, in a join that adaptive execution can split. The driver sees one row of sums a level.

Defined cases. Null url, or one without "://": host and path are empty, no rule fits, and the reputation of the empty host decides
(its domain and suffix are empty too). Very long urls are read whole. Repeated pages are rows like others; each that has labels counts. Several labels of one id: the
page is bad if any says so. Null page_id: no labels. Ties between rules of equal length: the lexically first. Columns besides page_id and
url aren't read by `judged`, whatever their names; `kept` returns them all. No labels: every posterior is the even prior,
so nothing is blocked under the given limit. No pages: an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged, table

#: The rules of the contract (fixed values): verdict, and host with the beginning of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of two labels under which domains are registered; all other suffixes are the last label.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
#: Standard deviations of the bound, and the bad share over which it blocks.
Z, LIMIT = 1.645, 0.5
#: Strength of priors, in labelled pages: least, most, and where a level tells nothing of it.
LEAST, MOST, UNKNOWN = 1.0, 1000.0, 10.0


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as a struct rule, verdict; null if none does. Rules are found by the host's suffixes, so a url costs
    as many look-ups as its host has labels, however many rules there are."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        by_host.setdefault(rule.partition("/")[0], []).append((rule, verdict))
    one = lambda r, v: F.struct((-F.lit(len(r))).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
    if not by_host:
        return F.lit(None).cast("struct<n: int, rule: string, verdict: string>")
    held = F.create_map(*[x for h, some in by_host.items() for x in (F.lit(h), F.array(*[one(r, v) for r, v in some]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = F.flatten(F.array_compact(F.transform(suffixes, lambda s: held[s])))
    fits = F.filter(some, lambda r: F.startswith(path, F.regexp_replace(r["rule"], "^[^/]*", "")))
    return F.when(host != "", F.array_min(fits))


def suffix(host: Column) -> Column:
    """The part under which domains are registered; of addresses in digits, nothing."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]*$"), F.lit("")).when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain(host: Column) -> Column:
    """The suffix and one label before it."""
    n = F.size(F.split(suffix(host), r"\.")) + 1
    labels = F.split(host, r"\.")
    return F.when(suffix(host) == "", host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))


def _strength(groups: DataFrame) -> float:
    """The prior's strength from groups of n pages, k of them bad, with the mean m that is expected: the correlation r within groups is
    fitted so that the sum of (k - n m)^2 is as expected, n m (1 - m) (1 + (n - 1) r); the strength is 1 / r - 1."""
    v = F.col("m") * (1 - F.col("m"))
    d = F.col("k") - F.col("n") * F.col("m")
    over, room = groups.agg(F.sum(d * d - F.col("n") * v), F.sum(F.col("n") * (F.col("n") - 1) * v)).head()
    if not room:
        return UNKNOWN
    r = over / room
    return MOST if r <= 0 else round(min(MOST, max(LEAST, 1 / r - 1)), 6)


def _level(counts: DataFrame, above: DataFrame | None, key: str, parent: str | None, start: float) -> DataFrame:
    """counts (key, parent, n, k) with mean, the posterior's mean, and a, b, its parameters. above has the parents' means."""
    if above is None:
        x = counts.withColumn("m", F.lit(start))
    else:
        x = counts.join(above.select(F.col(parent).alias("_p"), F.col("mean").alias("m")), F.col(parent) == F.col("_p")).drop("_p")
    s = _strength(x)
    x = x.withColumn("a", F.col("k") + s * F.col("m")).withColumn("b", F.col("n") - F.col("k") + s * (1 - F.col("m")))
    return staged(x.withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).drop("m"))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, domain, suffix, n, k, a, b, mean and bound of every host. pages: page_id, url; outcomes: page_id, bad (0 or 1)."""
    bad = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    p = pages.select(F.col("page_id").alias("_id"), host(F.col("url")).alias("host"))
    x = p.join(bad, F.col("_id") == F.col("page_id"), "left")
    x = x.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = staged(x.select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "k"))
    sums = [F.sum(c).alias(c) for c in "nk"]
    domains = staged(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    n, k = domains.agg(*[F.coalesce(s, F.lit(0)) for s in sums]).head()
    top = _level(suffixes, None, "suffix", None, (k + 0.5) / (n + 1.0))
    mid = _level(domains, top, "domain", "suffix", 0.0)
    low = _level(hosts, mid, "host", "domain", 0.0)
    a, b = F.col("a"), F.col("b")
    return low.withColumn("bound", F.col("mean") - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """Each page's page_id, host, path, rule, verdict and bound, the lower bound of its host's bad share."""
    r = reputation(pages, outcomes).select(F.col("host").alias("_h"), "bound")
    x = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    x = x.withColumn("_r", ruled(F.col("host"), F.col("path"), rules)).join(r, F.col("host") == F.col("_h"))
    by_method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return x.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), by_method).alias("verdict"), "bound")


def kept(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """The pages that are allowed, with all their columns."""
    r = reputation(pages, outcomes).select(F.col("host").alias("_h"), "bound")
    x = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    x = x.withColumn("_r", ruled(F.col("_host"), F.col("_path"), rules)).join(r, F.col("_host") == F.col("_h"))
    by_method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return x.filter(F.coalesce(F.col("_r.verdict"), by_method) == "allow").select("_row.*")


def labelled(labels: DataFrame) -> DataFrame:
    """Outcomes from `labels`: a page is bad if the label of its id is toxic or of low quality."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no outcomes of its own, so the label of the document with the page's id is taken as the page's."""
    return judged(table(spark, sf_dir, "pages"), labelled(table(spark, sf_dir, "labels"))).drop("bound")


def _level_sql(name: str, counts: str, above: str | None, key: str, parent: str) -> str:
    m = f"FROM (SELECT x.*, {'p.mean' if above else '(SELECT (sum(k) + 0.5e0) / (sum(n) + 1e0) FROM domains)'} AS m FROM {counts} x" + (f" JOIN {above} p USING ({parent}))" if above else ")")
    r = "sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m))"
    return f"""{name}m AS (SELECT * {m}),
{name}s AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 10e0 WHEN {r} <= 0 THEN 1000e0 ELSE round(least(1000e0, greatest(1e0, 1 / ({r}) - 1)), 6) END AS s FROM {name}m),
{name} AS (SELECT *, a / (a + b) AS mean FROM (SELECT {key}, {parent}, n, k, k + s * m AS a, n - k + s * (1 - m) AS b FROM {name}m, {name}s))"""


ORACLE = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
bad AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM u LEFT JOIN bad ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS l, CASE WHEN regexp_matches(host, '^[0-9.]*$') THEN 0 WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({", ".join(f"'{s}'" for s in LONG_SUFFIXES)}) THEN 2 ELSE 1 END AS parts FROM h0),
hosts AS (SELECT host, n, k, CASE WHEN parts = 0 THEN '' ELSE array_to_string(l[-least(parts, len(l)):], '.') END AS suffix, CASE WHEN parts = 0 THEN host ELSE array_to_string(l[-least(parts + 1, len(l)):], '.') END AS domain FROM h1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, suffix AS root, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
{_level_sql("top", "suffixes", None, "suffix", "root")},
{_level_sql("mid", "domains", "top", "domain", "suffix")},
{_level_sql("low", "hosts", "mid", "host", "domain")},
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}) AS t(verdict, rule)),
fit AS (SELECT DISTINCT u.host, u.path, rule, rules.verdict FROM (SELECT DISTINCT host, path FROM u) u JOIN rules
        ON (u.host = split_part(rule, '/', 1) OR ends_with(u.host, '.' || split_part(rule, '/', 1))) AND starts_with(u.path, substr(rule, instr(rule, '/')))),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, CASE WHEN mean - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN low ON u.host = low.host LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""
