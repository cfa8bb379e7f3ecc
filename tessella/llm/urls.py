"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes. DataFrame functions only.

Every URL is expanded into the pairs of a suffix of its host (at label borders) and a prefix of its path, of the numbers of
labels and characters that the rules have and no others. An equi-join on the first four bytes of SHA-256 finds candidates, the
whole digest then confirms them, and the longest rule wins; of equally long ones a block rule. Without a rule that fits,
``default`` is the verdict.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; repeated rows are judged
one by one; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, salted_join

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


#: Hexadecimal digits of the digest that rules and URLs are joined on: four bytes.
PREFIX = 8


def split_url(url):
    """(host, path) as strings, both empty for null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, default: str = "allow", rule_limit: int = 200_000) -> DataFrame:
    """page_id, host, path, rule (``host`` + ``path`` of the winner, or null), verdict of every row of ``pages`` (page_id, url).

    ``rules`` are (verdict, host, path). Up to ``rule_limit`` of them are broadcast (they are counted), more are shuffled.
    """
    if not isinstance(rules, DataFrame):
        made = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
        rules = pages.sparkSession.range(1).select(F.inline(made.cast("array<struct<verdict:string,host:string,path:string>>")))
    key = lambda host, path: F.sha2(F.concat_ws("\x1f", host, path), 256)
    short = lambda digest: F.conv(F.substring(digest, 1, PREFIX), 16, 10).cast("long")
    rules = rules.where("host <> '' and path is not null").select(F.col("verdict").alias("says"), F.concat("host", "path").alias("rule"), key("host", "path").alias("digest"), F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n"))
    rules = rules.withColumn("prefix", short(F.col("digest")))
    shapes = sorted(map(tuple, rules.select("k", "n").distinct().collect()))  # the rules' own lengths: few, whatever the pages hold
    host, path = split_url(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", r"\."))
    fits = lambda k, n: (F.lit(k) <= labels) & (F.lit(n) <= F.length("path"))
    digests = [F.when(fits(k, n), key(F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k, n in shapes]
    rows = rows.withColumn("digests", F.array_compact(F.array(*digests).cast("array<string>")))
    rows = rows.select("rid", "page_id", "host", "path", F.explode_outer("digests").alias("full")).withColumn("prefix", short(F.col("full")))
    if len(rules.select(F.lit(1)).take(rule_limit + 1)) <= rule_limit:
        hits = rows.join(F.broadcast(rules), "prefix", "left")
    else:
        hits = salted_join(rows, rules, "prefix", "rid", how="left")
    # not in the join, where it would take the prefix's place
    confirmed = F.when(F.col("full") == F.col("digest"), F.struct(F.length("rule").alias("n"), (F.col("says") == "block").alias("b"), "rule", "says"))
    out = hits.groupBy("rid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(confirmed).alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"))
