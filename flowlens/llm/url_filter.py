"""URL filters: listed rules first, then empirical-Bayes host reputation from labelled pages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, fold_ascii, ship, stage

#: Fixed values: (verdict, host and path) of the listed rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


#: Suffixes of two labels under which names are registered: the usual second-level names of these countries.
SECOND_LEVEL = tuple(f"{s}.{c}" for c in "ar au br cn hk id il in jp ke kr mx my nz ph sg th tr tw uk za".split() for s in "ac co com edu gov net org".split())


@dataclass(frozen=True)
class Reputation:
    """How labelled outcomes turn into verdicts.

    A host is blocked if its share of bad pages is above most_bad with a posterior probability of sure or
    more, which is to say if the lower bound of its credible interval at that level is above most_bad. weakest,
    strongest: limits of a prior's strength in pages. suffixes: those of two to four labels under which names are
    registered, a public list of them for instance; any other suffix is the last label.
    """

    most_bad: float = 0.2
    sure: float = 0.95
    weakest: float = 1.0
    strongest: float = 1000.0
    suffixes: tuple[str, ...] = SECOND_LEVEL


def host_of(url: Column) -> Column:
    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column, how: Reputation) -> tuple[Column, Column]:
    """Suffix and registered domain of a host without its user part, port and trailing dots; addresses in numbers are both themselves."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    suffix, domain = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    for labels in range(2, 5):
        known = [x for x in how.suffixes if x.count(".") == labels - 1]
        if known:
            longer = F.substring_index(name, ".", -labels).isin(known)
            suffix, domain = F.when(longer, F.substring_index(name, ".", -labels)).otherwise(suffix), F.when(longer, F.substring_index(name, ".", -labels - 1)).otherwise(domain)
    return F.when(number, name).otherwise(suffix), F.when(number, name).otherwise(domain)


def above(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """P(share > x) of beta distributions (a, b), by the continued fraction of the incomplete beta function; a = 0 is a share of 0, b = 0 of 1."""
    out = np.where(b <= 0, 1.0, 0.0)
    live = np.flatnonzero((a > 0) & (b > 0))
    if not len(live):
        return out
    a, b = a[live].astype(float), b[live].astype(float)
    swap = x > (a + 1) / (a + b + 2)  # where the other end's fraction converges faster
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones(len(p)), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 5_000):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for t in (even, odd):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f *= c * d
        if np.all(np.abs(c * d - 1) < 1e-13):
            break
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    out[live] = np.clip(np.where(swap, front * f, 1 - front * f), 0, 1)
    return out


def _strength(parts: DataFrame, parent: str, p0: float, how: Reputation) -> float:
    """The strength of a level's beta prior by moments: how far groups (n, bad) lie from their parents' share."""
    groups = parts.where("n > 0")
    up = groups.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"), F.sum(F.col("n") * F.col("n")).alias("pq"), F.count(F.lit(1)).alias("g"))
    far = F.col("n") * (F.col("bad") / F.col("n") - F.col("pb") / F.col("pn")) * (F.col("bad") / F.col("n") - F.col("pb") / F.col("pn"))
    between = groups.join(up.select(parent, "pn", "pb"), parent).agg(F.sum(far)).first()[0]
    free, spread = up.agg(F.sum(F.col("g") - 1), F.sum(F.col("pn") - F.col("pq") / F.col("pn"))).first()
    if between is None or not 0 < p0 < 1 or spread - free <= 0:
        return how.strongest
    rho = (between / (p0 * (1 - p0)) - free) / (spread - free)
    return how.strongest if rho <= 0 else min(how.strongest, max(how.weakest, 1 / rho - 1))


def url_filter(pages: DataFrame, outcomes: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, how: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: the id, host, path, rule, verdict, bad_mean, bad_prob.

    outcomes: (id, bad), bad 0 or 1; null ids or outcomes are left out, repeated ones count each. A host's
    share of bad pages has a beta posterior, whose prior is centred on its registered domain's share,
    that one's on its suffix's, and that one's on all pages'; each level's strength is estimated by moments
    from how far groups lie from the level above, and no outcome counts at two levels of one host.
    Hosts without outcomes rest on the levels above; without any outcome nothing is blocked but by rules.

    bad_mean is the posterior's mean, bad_prob the probability that the share is above most_bad.

    A null url or one without :// has empty host and path, and is a host of its own; very long urls are urls like any other.
    Repeated pages each get their row and count as often. The listed rules are a short list in the plan. Hosts are counted
    before the shuffle, and pages of hosts that hold a large share of all rows are joined where they are. An empty table of
    pages gives no rows. Other columns, whatever their names, are not read.
    """
    ship(pages.sparkSession)
    url = F.col(url_col)
    host = host_of(url).alias("host")
    base = pages.select(F.col(id_col).alias("id"), host, path_of(url).alias("path"))
    seen = outcomes.toDF("oid", "bad").where("oid IS NOT NULL AND bad IS NOT NULL")
    judged = pages.select(F.col(id_col).alias("id"), host).join(seen, F.col("id") == F.col("oid")).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"), how)
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).join(judged, "host", "left").na.fill(0, ["n", "bad"])
    hosts = stage(hosts.select("host", "rows", "n", "bad", suffix.alias("suffix"), domain.alias("domain"), F.lit(0).alias("all")), "url-hosts")
    total, n, bad = hosts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    p0 = bad / n if n else 0.0

    level = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes, domains = level("all", "suffix"), level("suffix", "domain")
    ks, kd, kh = _strength(suffixes, "all", p0, how), _strength(domains, "suffix", p0, how), _strength(hosts, "domain", p0, how)
    # each level's centre leaves out what the level below has seen itself, and its own uncertainty weakens it
    s = suffixes.select("suffix", F.col("n").alias("ns"), F.col("bad").alias("bs"))
    d = domains.join(s, "suffix")
    n_up = F.col("ns") - F.col("n") + F.lit(ks)
    d = d.select("domain", "suffix", F.col("n").alias("nd"), F.col("bad").alias("bd"), ((F.col("bs") - F.col("bad") + F.lit(ks * p0)) / n_up).alias("ps"), (1 / (1 / F.lit(kd) + 1 / n_up)).alias("kd"))
    h = hosts.join(d, ["suffix", "domain"])
    n_up = F.col("nd") - F.col("n") + F.col("kd")
    h = h.withColumn("pd", (F.col("bd") - F.col("bad") + F.col("kd") * F.col("ps")) / n_up).withColumn("kh", 1 / (1 / F.lit(kh) + 1 / n_up))
    a = F.col("bad") + F.col("kh") * F.col("pd")
    b = F.col("n") - F.col("bad") + F.col("kh") * (1 - F.col("pd"))
    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, q = (x.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            mean = p / np.where(p + q > 0, p + q, 1)
            yield pa.RecordBatch.from_arrays([x.column("host"), x.column("rows"), pa.array(mean), pa.array(above(p, q, how.most_bad))], ["host", "rows", "bad_mean", "bad_prob"])

    known = h.select("host", "rows", a.cast("double").alias("a"), b.cast("double").alias("b")).mapInArrow(tail, "host string, rows long, bad_mean double, bad_prob double")

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged_by = F.coalesce(verdict, F.when(F.col("bad_prob") >= how.sure, F.lit("block")).otherwise(F.lit("allow")))
    return attach(base, stage(known, "url-known"), ["host"], "rows", total).select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), judged_by.alias("verdict"), "bad_mean", "bad_prob")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the outcome of a page is the quality label of the document with its id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("bad"))
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bad_mean", 5).alias("bad_mean"), F.round("bad_prob", 4).alias("bad_prob"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS name FROM p
), parts AS (
  SELECT *, regexp_matches(name, '^[0-9]+(\\.[0-9]+){3}$|^\\[') AS num, list_reverse(string_split(name, '.')) AS l, array_to_string(list_slice(string_split(name, '.'), greatest(len(string_split(name, '.')) - 1, 1), len(string_split(name, '.'))), '.') AS last2 FROM bare
), named AS (
  SELECT page_id, host, path, CASE WHEN num THEN name WHEN dbl THEN last2 ELSE l[1] END AS suffix,
         CASE WHEN num THEN name WHEN dbl AND len(l) > 2 THEN l[3] || '.' || last2 ELSE last2 END AS domain
  FROM (SELECT *, last2 IN (SECOND_LEVEL) AS dbl FROM parts)
), h AS (
  SELECT host, any_value(suffix) AS suffix, any_value(domain) AS domain, count(quality) AS n, coalesce(sum(1 - quality), 0) AS bad
  FROM named LEFT JOIN labels ON page_id = doc_id GROUP BY host
), g AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS p0 FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
lv AS (
  SELECT 's' AS lv, '' AS up, n, bad FROM s WHERE n > 0 UNION ALL
  SELECT 'd', suffix, n, bad FROM d WHERE n > 0 UNION ALL
  SELECT 'h', domain, n, bad FROM h WHERE n > 0
), up AS (SELECT lv, up, sum(n) AS pn, sum(bad) AS pb, sum(n * n) AS pq, count(*) AS gr FROM lv GROUP BY ALL),
m AS (
  SELECT lv, between_, free, spread FROM
    (SELECT lv, sum(n * (bad / n - pb / pn) * (bad / n - pb / pn)) AS between_ FROM lv JOIN up USING (lv, up) GROUP BY lv) JOIN
    (SELECT lv, sum(gr - 1) AS free, sum(pn - pq / pn) AS spread FROM up GROUP BY lv) USING (lv)
), r AS (SELECT lv, CASE WHEN p0 > 0 AND p0 < 1 AND spread - free > 0 THEN (between_ / (p0 * (1 - p0)) - free) / (spread - free) ELSE 0 END AS rho FROM m, g),
k AS (SELECT lv, CASE WHEN rho <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0, greatest(1.0, 1 / rho - 1)) END AS k FROM r),
kk AS (SELECT coalesce(max(k) FILTER (lv = 's'), 1000) AS ks, coalesce(max(k) FILTER (lv = 'd'), 1000) AS kd, coalesce(max(k) FILTER (lv = 'h'), 1000) AS kh FROM k),
pd AS (
  SELECT d.suffix, domain, d.n AS nd, d.bad AS bd, (s.bad - d.bad + ks * p0) / (s.n - d.n + ks) AS ps, 1 / (1 / kd + 1 / (s.n - d.n + ks)) AS kd2
  FROM d JOIN s USING (suffix), g, kk
), ph AS (SELECT host, n, bad, (bd - bad + kd2 * ps) / (nd - n + kd2) AS pd, 1 / (1 / kh + 1 / (nd - n + kd2)) AS kh2 FROM h JOIN pd USING (suffix, domain), kk),
ab AS (SELECT host, bad + kh2 * pd AS a, n - bad + kh2 * (1 - pd) AS b FROM ph),
-- the tail beyond 0.2 by Simpson's rule, t = s ** k making the integrand smooth at 0
sp AS (SELECT host, a, b, greatest(1, 4 / a) AS k, pow(0.2, 1 / greatest(1, 4 / a)) AS top FROM ab WHERE a > 0 AND b > 0),
nodes AS (SELECT unnest(range(1, 1001)) AS i),
area AS (
  SELECT host, sum(CASE WHEN i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((k * a - 1) * ln(top * i / 1000) + (b - 1) * ln(1 - pow(top * i / 1000, k)) + ln(k) + lgamma(a + b) - lgamma(a) - lgamma(b))) * any_value(top) / 3000 AS below
  FROM sp, nodes GROUP BY host
), rep AS (
  SELECT ab.host, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END AS bad_mean, CASE WHEN b <= 0 THEN 1.0 WHEN a <= 0 THEN 0.0 ELSE least(1, greatest(0, 1 - below)) END AS bad_prob FROM ab LEFT JOIN area USING (host)
),
f AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
       ELSE CASE WHEN bad_prob >= 0.95 THEN 'block' ELSE 'allow' END END AS verdict, round(bad_mean, 5) AS bad_mean, round(bad_prob, 4) AS bad_prob
FROM f LEFT JOIN rep USING (host)
""".replace("SECOND_LEVEL", ", ".join(f"'{s}'" for s in SECOND_LEVEL))
