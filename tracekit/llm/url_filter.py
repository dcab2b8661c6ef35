"""URL filter: a sort-merge range join of URLs with nested host and path rules.

A rule (host, path, action) fits a URL if the URL's host is the rule's host
or a subdomain of it and its path starts with the rule's. With host labels
reversed and the path behind them, a rule becomes a prefix, and a prefix is
an interval of the byte order: from the prefix to the prefix plus 0xFF, a
byte that UTF-8 never contains. Intervals of prefixes nest or are disjoint,
so one sorted pass over URLs and interval ends with a stack of the open
rules finds, for each URL, the innermost rule.

A host a.example.net can be fitted by rules for net, example.net and itself,
each with a path of its own, so a URL takes part once for each of its
trailing label groups, as deep as the deepest rule goes and no deeper.

Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracekit.llm._common import ascii_lower, literal_rows, partitions, written

# fixed values: the rule list of the contract
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

OPENS, URL, CLOSES = 0, 1, 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first ``://`` up to ``/``, ``?``,
    ``#`` or the end, with A-Z lower-cased; the path goes on up to ``?``,
    ``#`` or the end. Both are empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(ascii_lower(host), none), F.coalesce(path, none)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) rows of a literal rule list."""
    return literal_rows(spark, rules, "host string, path string, action string")


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path), "UTF-8")


def _boundaries(rules: DataFrame) -> DataFrame:
    """Interval ends with the stack of rules that are open behind them.

    The stack of a rule is found by joining its key's own prefixes with the
    rules' keys: at most as many rows as the key has bytes.
    """
    rule = (rules.where("host is not null and path is not null and host <> ''")
            .select(_key(F.split(ascii_lower(F.col("host")), r"\."), F.col("path")).alias("key"),
                    F.concat(ascii_lower(F.col("host")), F.col("path")).alias("rule"),
                    F.size(F.split("host", r"\.")).alias("labels"), "action")
            .groupBy("key").agg(F.max(F.struct(F.length("rule").alias("length"), "labels", "action", "rule")).alias("own")))
    prefix = rule.select(F.col("key").alias("of"), F.explode(F.sequence(F.lit(1), F.octet_length("key"))).alias("n"))
    prefix = prefix.select("of", F.expr("substring(of, 1, n)").alias("key"))
    open_at = (prefix.join(rule, "key").groupBy("of")
               .agg(F.array_sort(F.collect_list(F.struct(F.octet_length("key").alias("n"), "own"))).alias("open")))
    stack = F.transform("open", lambda x: x["own"])
    opens = open_at.select(F.col("of").alias("key"), F.lit(OPENS).alias("kind"), stack.alias("stack"))
    closes = open_at.select(F.concat("of", F.unhex(F.lit("FF"))).alias("key"), F.lit(CLOSES).alias("kind"),
                            F.slice(stack, 1, F.size("open") - 1).alias("stack"))
    return opens.unionByName(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    The longest fitting rule (in characters of host and path together, then
    in labels, then block before allow) gives rule and verdict; without one,
    rule is null and the verdict is ``default``. Null, empty or odd URLs have
    an empty host and path. Repeated rows stay repeated, null ids stay, extra
    columns of ``pages`` are not used. Rules with a null or empty host are
    left out; an empty rule table or page table works.

    URLs and interval ends are range-partitioned by key and, within a key, by
    row, so a frequent host or URL is split. Each chunk is then swept alone:
    the stack that is open where a chunk starts is the last one of the chunks
    before it, one row per chunk. Runs jobs for the range bounds.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    boundaries = written(_boundaries(rules), "url-rules")
    deepest = boundaries.select(F.explode("stack").alias("r")).agg(F.max("r.labels")).first()[0]
    if deepest is None:
        return urls.select(F.col("id").alias(id_col), "host", "path",
                           F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.")
    depth = F.explode(F.sequence(F.lit(1), F.least(F.lit(deepest), F.size(labels))))
    keyed = urls.select("id", "host", "path", depth.alias("depth"))
    tail = F.slice(labels, F.size(labels) - F.col("depth") + 1, F.col("depth"))
    probes = keyed.select(_key(tail, F.col("path")).alias("key"), F.lit(URL).alias("kind"),
                          "id", "host", "path", "depth", F.monotonically_increasing_id().alias("row"))

    events = probes.unionByName(boundaries, allowMissingColumns=True)
    chunks = written(events.repartitionByRange(partitions(spark), "key", "kind", "row")
                     .withColumn("chunk", F.spark_partition_id()), "url-events")
    # what the chunks before left open: one row per chunk
    left = (chunks.where(F.col("kind") != URL).groupBy("chunk")
            .agg(F.max_by("stack", F.struct("key", "kind")).alias("stack")))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (chunks.groupBy("chunk").agg(F.count("*").alias("n")).join(left, "chunk", "left")
               .select("chunk", F.last("stack", ignorenulls=True).over(earlier).alias("carried")))

    sweep = Window.partitionBy("chunk").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_now = F.coalesce(F.last("stack", ignorenulls=True).over(sweep), F.col("carried"))
    swept = (chunks.join(F.broadcast(carried), "chunk")  # one row per chunk
             .select("kind", "id", "host", "path", "depth", open_now.alias("stack"))
             .where(F.col("kind") == URL))
    top = F.try_element_at("stack", F.lit(-1))
    best = (swept.groupBy("id", "host", "path")
            .agg(F.max(top).alias("best"), F.count(F.when(F.col("depth") == 1, 1)).alias("n")))
    return (best.select("id", "host", "path", "best", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.action", F.lit(default)).alias("verdict")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` under the contract's rules; others are allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, rule_table(spark, RULES))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                       ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                   ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, r.rhost || r.rpath AS rule, action,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR suffix(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
