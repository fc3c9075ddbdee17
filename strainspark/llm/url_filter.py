"""URL verdicts by a sort-merge sweep over nested rule intervals, in DataFrame functions only.

A host is written with its labels reversed and each label ended by \\x01, so the
hosts under a rule's host are the keys of one interval, and any two intervals are
nested or apart.  A sweep in key order meets interval starts, interval ends and
URLs; after each start or end the stack of the rules that are active is known,
and each URL takes the stack of the last one before it.  Of the stack, the
longest rule whose path begins the URL's path decides.

URLs are dealt by a hash of the row into sweeps, each over all starts and ends, so
a host that holds a third of all rows is spread like any other, and one shuffle and
one sort do the join.  Sweeps are a multiple of the session's shuffle partitions, so
their number grows with the cluster; the rules are repeated in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sweeps to a shuffle partition, so that their hashes fill all partitions about evenly.
SLICES_EACH = 4

#: The rules of the query: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

STACK = "array<struct<n:int,host:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    part = F.coalesce(F.regexp_extract(url, r"^(?s:(?:(?!://).)*)://([^/?#]*)", 1), F.lit(""))
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:(?:(?!://).)*)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001"))


def sweep_events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack) of each interval's start (0) and end (2); the stack is what is active after it.

    Rules enclose each other by whole labels, so a rule's stack is found by looking
    up the hosts above its own, one for each label.
    """
    by_host = rules.groupBy("host").agg(F.array_sort(F.collect_set(F.struct((F.length("host") + F.length("path")).cast("int").alias("n"), "host", "path", "verdict"))).alias("own"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    up = by_host.select("host", F.explode(above).alias("over")).alias("r").join(by_host.select(F.col("host").alias("over"), "own"), "over")
    stacks = up.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("all"), F.flatten(F.collect_list(F.when(F.col("over") != F.col("host"), F.col("own")))).alias("outer"))
    key = host_key(F.col("host"))
    event = F.explode(F.array(
        F.struct(key.alias("key"), F.lit(0).alias("kind"), F.col("all").cast(STACK).alias("stack")),
        F.struct(F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("\u0002")).alias("key"), F.lit(0).alias("kind"), F.col("outer").cast(STACK).alias("stack"))))
    return stacks.withColumn("k", key).select(event.alias("e")).select("e.*")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", slices: int | None = None) -> DataFrame:
    """``urls`` with host, path, rule and verdict, which replace columns of these names.

    ``rules``: (verdict, host, path).  A rule fits its host and all hosts under
    it if the URL's path starts with the rule's; the longest fitting rule wins
    and, of rules of one length, the last by host, path and verdict.  Without a
    fitting rule, rule is null and the verdict ``default``.  A null URL, or one
    without ``://``, has an empty host and path.  Rules with a null are left out,
    repeated rules count once; repeated URL rows are judged each.  ``slices`` is the
    number of sweeps, by default SLICES_EACH for each shuffle partition.
    """
    slices = slices or SLICES_EACH * int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.select("verdict", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path").dropna().filter("host <> ''").distinct()
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    probes = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    probes = probes.select("row", "host", "path", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(STACK).alias("stack"), F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"))
    events = sweep_events(rules)
    repeated = events.select("key", "kind", "stack", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = probes.unionByName(repeated, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    fitting = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fitting)
    return swept.withColumn("best", best).select("row.*", "host", "path", F.concat(F.col("best.host"), F.col("best.path")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(verdict, host, path) of listed rules, as literals of the plan."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def report(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page row, under RULES."""
    return judge(pages.select("page_id", "url"), rule_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


REPORT_SQL = """
WITH u AS (SELECT row_number() OVER () AS row, page_id, coalesce(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '') AS h, url,
                  strpos(url, '://') AS pos FROM pages),
p AS (SELECT row, page_id, CASE WHEN coalesce(pos, 0) = 0 THEN '' ELSE translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
             CASE WHEN coalesce(pos, 0) = 0 THEN '' ELSE regexp_extract(substr(url, pos + 3 + length(h)), '^[^?#]*') END AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT p.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
