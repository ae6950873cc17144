"""Queries of the table of deltas: its rows after several writes, what changed between versions, and statistics that follow the changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deltas, views
from ..operators.shared import scratch
from .queries import register, table

_COLUMNS = "user_id bigint, event_id bigint, event_type string, value double, capturado timestamp, visto_ultima_vez timestamp, vigente boolean"
# A user's last event of each of four batches; before the last batch every tenth user's row is patched.
_BATCHES = """with l as (select user_id, event_id, event_type, value, event_id % 4 as b from events qualify row_number() over (partition by user_id, event_id % 4 order by ts desc, event_id desc) = 1),
f as (select user_id, min(b) as first, max(b) as last, arg_max(event_id, b) as event_id, arg_max(event_type, b) as event_type, arg_max(value, b) as value from l group by user_id),
o as (select user_id, arg_max(event_id, b) as event_id, arg_max(event_type, b) as event_type, arg_max(value, b) as value, max(b) as last from l where b < 2 group by user_id),
t as (select user_id, case when user_id % 10 = 0 and last < 3 then -event_id else event_id end as event_id, event_type, value, timestamp '2026-01-01' + to_days(cast(first as int)) as capturado, timestamp '2026-01-01' + to_days(cast(last as int)) as visto from f)
"""


def _written(spark, d) -> tuple[str, list[int]]:
    """The table, and its versions after each batch (the last one after merging)."""
    where, after = f"{scratch(spark)}/t", []
    deltas.create(spark, where, _COLUMNS, "user_id")
    events = table(spark, d, "events")
    for b in range(4):
        if b == 3:
            kept = deltas.read(spark, where).filter("user_id % 10 = 0")
            deltas.patch(spark, where, kept.withColumn("event_id", -F.col("event_id")))
        after.append(deltas.put(spark, where, events.filter(F.col("event_id") % 4 == b), F.lit(f"2026-01-0{b + 1} 00:00:00").cast("timestamp"), ("ts", "event_id")))
    return where, after


@register("delta_store", _BATCHES + "select user_id, event_id, event_type, value, capturado, visto from t")
def delta_store(spark, d):
    """Events put by user in four writes and a patch, merged when read."""
    where, _ = _written(spark, d)
    deltas.compact(spark, where, 3)
    ntz = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    return deltas.read(spark, where).select("user_id", "event_id", "event_type", "value", ntz("capturado", "capturado"), ntz("visto_ultima_vez", "visto"))


@register("delta_changes", _BATCHES + "select t.user_id, o.event_id as antes, t.event_id as despues from t left join o using (user_id) where o.user_id is null or f_last >= 2 or t.event_id <> o.event_id".replace("f_last", "(select last from f where f.user_id = t.user_id)"))
def delta_changes(spark, d):
    """Rows that differ between the version after the second batch and the last one, buckets merged in between."""
    where, after = _written(spark, d)
    deltas.compact(spark, where, 2)
    return deltas.changes(spark, where, after[1], deltas.versions(spark, where)[-1]).select("user_id", F.col("antes.event_id").alias("antes"), F.col("despues.event_id").alias("despues"))


@register("delta_statistics", _BATCHES + ", m as (select event_type, list_sort(list(value)) as v, count(*) as total, count(*) filter (user_id % 2 = 0) as con from t group by event_type) select event_type, total, con as con_sueldo, v[len(v) // 2 + 1] as mediana from m")
def delta_statistics(spark, d):
    """Counts, shares and medians by type, made once after the first batch and then changed by what each further one changed."""
    where, after = _written(spark, d)
    groups = {"event_type": F.col("event_type"), "par": F.col("user_id") % 2 == 0}
    view = views.build(deltas.read(spark, where, after[0]), groups, F.col("value"))
    for a, b in zip(after, after[1:]):
        view = views.refresh(view, deltas.changes(spark, where, a, b), groups, F.col("value"))
    return views.shares(view, ["event_type"], "par").select("event_type", "total", "con_sueldo").join(views.medians(view, "event_type"), "event_type")
