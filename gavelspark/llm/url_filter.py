"""URL filters as a sort-merge range join.

A host with its labels reversed, ``org.example.``, is a key under which a host and all its
subdomains are one interval of the sort order. Urls and the ends of the rules' intervals are
sorted together; a sweep over them keeps the stack of rules whose intervals are open, and each
url is judged by the rules on the stack where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm.common import picked
from gavelspark.operators.ranges import PART, in_ranges

RULE = "array<struct<host:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in
    lower case; empty for null and for other texts."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels reversed, each with a dot behind it: subdomains sort right behind their domain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def interval_ends(rules: DataFrame) -> DataFrame:
    """``at`` and ``stack``: from each of these keys on, the rules that are open.

    Intervals nest or lie apart. At a host's key its rules come onto those of the domains above
    it; right behind its last subdomain (the dot that ends its key becomes a slash, the next
    character) they come off again, which leaves those above. Where an interval ends and
    another begins at the same key, the one that begins says what is open.
    """
    own = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
        .select("host", "path", "verdict")
        .distinct()
    )
    by_host = own.groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("rules"))
    labels = F.split("host", r"\.", -1)
    above = by_host.select(
        "host", "rules", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("from")
    ).select(
        "host", "rules", "from",
        F.array_join(F.slice(labels, F.col("from"), F.size(labels)), ".").alias("domain"),
    )
    held = by_host.select(F.col("host").alias("domain"), F.col("rules").alias("held"))
    chains = above.join(held, "domain").groupBy("host").agg(
        F.flatten(F.collect_list("held")).alias("stack"),
        F.flatten(F.collect_list(F.when(F.col("from") > 1, F.col("held")))).alias("outer"),
    )
    key = host_key(F.col("host"))
    closed = F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/"))
    ends = chains.select(key.alias("k"), "stack", "outer")
    return ends.select(F.col("k").alias("at"), "stack", F.lit(1).alias("opens")).unionByName(
        ends.select(closed.alias("at"), F.col("outer").alias("stack"), F.lit(0).alias("opens"))
    )


def judged(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` for each row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains
    if the url's path starts with the rule's; the longest fitting rule (host and path) wins, of
    equally long ones that of the longer host, then a block. Without one ``rule`` is null and
    the verdict is ``default``. Rules with a null or without a host fit nothing. Null urls and
    urls without ``://`` have an empty host and path. Repeated rows each get a result.

    The rows are dealt by ranges of the sort order, cut at the row's key too, so a host with
    any share of all urls spreads over many tasks. A range takes over the stack from the last
    interval end before it.
    """
    address = F.col("url")
    points = picked(pages, id=key, url=url).select(
        "id",
        host_of(address).alias("host"),
        path_of(address).alias("path"),
        F.xxhash64("id", "url").alias("spread"),
    )
    points = points.withColumn("at", host_key(F.col("host")))
    ends = interval_ends(rules.select("host", "path", "verdict"))
    both = points.select(
        "at", F.lit(2).alias("order"), "spread", "id", "host", "path", F.lit(None).cast(RULE).alias("stack")
    ).unionByName(
        ends.select(
            "at",
            F.col("opens").alias("order"),
            F.lit(0).cast("long").alias("spread"),
            F.lit(None).cast(points.schema["id"].dataType).alias("id"),
            F.lit(None).cast("string").alias("host"),
            F.lit(None).cast("string").alias("path"),
            "stack",
        )
    )
    order = [F.col("at"), F.col("order"), F.col("spread"), F.col("id")]
    ranged = in_ranges(both, *order)
    sweep = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
    last = ranged.groupBy(PART).agg(
        F.max_by("stack", F.when(F.col("order") < 2, F.struct("at", "order"))).alias("last")
    )
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = last.select(PART, F.last("last", ignorenulls=True).over(before).alias("carried"))
    placed = swept.where(F.col("order") == 2).join(F.broadcast(carried), PART)
    fitting = F.filter(
        F.coalesce("open", "carried", F.array().cast(RULE)),
        lambda rule: F.col("path").startswith(rule["path"]),
    )
    ranked = F.transform(
        fitting,
        lambda rule: F.struct(
            (F.length(rule["host"]) + F.length(rule["path"])).alias("length"),
            F.length(rule["host"]).alias("host_length"),
            (rule["verdict"] == "block").alias("blocks"),
            F.concat(rule["host"], rule["path"]).alias("rule"),
            rule["verdict"].alias("verdict"),
        ),
    )
    return placed.select("id", "host", "path", F.array_max(ranked).alias("won")).select(
        F.col("id").alias(key),
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )
