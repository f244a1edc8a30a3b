"""URL rules by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's.  Hosts are reversed label by label, and a host with its ancestors is a chain of
such keys, so under one host key a rule's path prefix is an interval of sorted paths.
Rules and urls are brought together by host key and salt, sorted by path, and one sweep
over each sorted partition keeps a stack of the nested rules whose interval is open; its
top is the longest fitting path.  A url is sent under each of its ancestors that has a
rule, and once without; the longest rule of these answers is its verdict.

Urls of one host are spread over ``salts`` partitions' keys (rules, which are few, are
repeated for each salt), so a host with a third of all rows is not one task's work.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import map_batches, read

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end.  A null url or one
    without ``://`` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www``."""
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def ancestors(host: Column) -> Column:
    """The reversed keys of a host and of the domains above it, shortest first."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def _sweep():
    """Rows sorted by (host key, salt, path, kind); kind 0 is a rule, 1 a url.  The stack
    outlives a batch, as a key's rows may go on in the next."""
    state: dict = {"at": None, "stack": []}

    def handle(batch: pa.RecordBatch):
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        out: dict[str, list] = {"page_id": [], "url": [], "rule": [], "action": []}
        stack = state["stack"]
        for key, salt, path, kind, page, url, rule, action in zip(*(cols[c] for c in ("key", "salt", "path", "kind", "page_id", "url", "rule", "action")), strict=True):
            if state["at"] != (key, salt):
                state["at"] = (key, salt)
                stack.clear()
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                # of rules with the same host and path the one sorted first stands
                if not stack or stack[-1][0] != path:
                    stack.append((path, rule, action))
            elif stack:
                out["page_id"].append(page)
                out["url"].append(url)
                out["rule"].append(stack[-1][1])
                out["action"].append(stack[-1][2])
        yield out

    return handle


#: Rows of the table for each salt, so that no host gives a task many more.
PER_SALT = 1 << 20


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """``key``, host, path, rule and verdict for each row of ``pages``.

    ``rules`` has action, host and path (strings; rows with a null are ignored).  The
    longest rule (host and path together) wins, of equally long ones the one with the
    longer host, of rules with the same host and path a block before an allow; a url that
    no rule fits gets ``default`` and a null rule.  Null urls and null keys keep their
    row; repeated rows each keep theirs.  Other columns are not read.  A host's urls are
    dealt to ``salts`` parts, one for each PER_SALT rows of the table (32 at least).
    """
    salts = salts or max(32, -(-pages.count() // PER_SALT))
    rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna().select(
        reversed_host(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "action"
    )
    # one row for each distinct (key, url), with its number of copies: the verdict is the same for all
    urls = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    host, path = host_path(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    hosts = rules.select("key").distinct()
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    sent = (
        urls.select("page_id", "url", "path", salt.alias("salt"), F.explode(ancestors(F.col("host"))).alias("key"))
        .join(hosts, "key", "left_semi")
        .select("key", "salt", "path", F.lit(1).alias("kind"), "page_id", "url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    )
    kept = rules.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "path", F.lit(0).alias("kind"), F.lit(None).cast(dict(pages.dtypes)[key]).alias("page_id"), F.lit(None).cast("string").alias("url"), "rule", "action")
    both = sent.unionByName(kept).repartition("key", "salt").sortWithinPartitions("key", "salt", "path", "kind", F.col("action").desc())
    found = map_batches(both, _sweep, f"page_id {dict(pages.dtypes)[key]}, url string, rule string, action string")
    best = found.groupBy("page_id", "url").agg(F.max(F.struct(F.length("rule").alias("n"), F.length(F.regexp_extract("rule", r"^[^/]*", 0)).alias("h"), "rule", "action")).alias("best"))
    judged = urls.alias("u").join(best.alias("b"), F.col("u.page_id").eqNullSafe(F.col("b.page_id")) & F.col("u.url").eqNullSafe(F.col("b.url")), "left")
    return judged.select(
        F.col("u.page_id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    ).drop("copy")


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "action string, host string, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), rules_frame(spark))


_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(action, rule_host, rule_path) AS (VALUES {_VALUES}),
counted AS (SELECT row_number() OVER () AS r, page_id, host, path FROM parts),
fits AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM counted JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM counted LEFT JOIN fits USING (r)
"""
