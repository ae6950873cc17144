"""When each address may be fetched, and by whom (S21): a table of slots, under each host's delay and a number of fetchers.

Hosts are put in order of their delay and dealt to fetchers in stretches of equal work, so hosts
that must be waited for alike share a fetcher. A fetcher goes round its hosts: in each round one
address of each, at the host's place in the round. A round lasts as long as the longest delay of
its hosts, or as its fetches take. So a host is never asked before its delay is over, no fetcher
has two things to do at once, and one that waits for a host serves its other hosts meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import running
from .crawl import wait_seconds


def fetch_schedule(urls: DataFrame, policies: DataFrame, fetchers: int, seconds: float = 1.0) -> DataFrame:
    """host, url, fetcher (from 0), ronda (from 0), inicio (seconds from the start) of every address.

    urls: host, url, pos (the order within a host; ties go by url); policies: host, delay as of
    robots_policy (hosts without one wait the least). An address counts once, at its first place.
    No task ranks a host's addresses or all hosts: both are placed by ranges."""
    each = urls.groupBy("host", "url").agg(F.min("pos").alias("pos"))
    told = policies.groupBy(F.col("host").alias("_host")).agg(F.max("delay").alias("delay"))
    hosts = each.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(told, F.col("host").eqNullSafe(F.col("_host")), "left")
    hosts = hosts.select("host", "n", F.greatest(wait_seconds(F.col("delay")), F.lit(float(seconds))).alias("wait"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    dealt = running(hosts, ["wait", "host"], F.col("n"), "before").withColumn("fetcher", F.floor(F.col("before") * fetchers / F.lit(max(total, 1))).cast("int"))
    placed = running(dealt, ["wait", "host"], F.lit(1).cast("long"), "place", ("fetcher",))
    rounds = placed.groupBy(F.col("fetcher").alias("_f")).agg(F.greatest(F.max("wait"), F.count(F.lit(1)) * F.lit(float(seconds))).alias("round"))  # a row for each fetcher
    placed = placed.join(F.broadcast(rounds), F.col("fetcher") == F.col("_f")).select(F.col("host").alias("_of"), "fetcher", "place", "round")
    ranked = running(each, ["pos", "url"], F.lit(1).cast("long"), "ronda", ("host",))
    slots = ranked.join(placed, F.col("host").eqNullSafe(F.col("_of")))
    return slots.select("host", "url", "fetcher", "ronda", (F.col("ronda") * F.col("round") + F.col("place") * F.lit(float(seconds))).alias("inicio"))
