"""Queries over `events`: windows on the table; a stream gives the same rows (see the tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import events as S
from .common import table


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return S.tumbling(table(spark, d, "events"), "1 hour")


_TUMBLING = "select (floor(epoch(ts))::bigint // 3600) * 3600 as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2"


def events_session(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(table(spark, d, "events"), "30 minutes")


_SESSION = """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as k from e) select user_id, floor(epoch(min(ts)))::bigint as session_start, count(*) as n from s group by user_id, k"""

QUERIES = {f.__name__: f for f in (events_tumbling, events_session)}
ORACLE_SQL = {"events_tumbling": _TUMBLING, "events_session": _SESSION}
