"""Event-time windows over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.registry import query
from tallyforge.streaming import windows



def _count():
    return F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")


query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")(
    lambda t: windows.tumbling(t.events, "ts", "1 hour", ["event_type"], *_count())
)
query("stream_sliding", "SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS v FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w")(
    lambda t: windows.sliding(t.events, "ts", "2 hours", "1 hour", [], *_count())
)
_FRESH = "SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events"
query("stream_sessions", f"SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM ({_FRESH})) GROUP BY user_id, s")(
    lambda t: windows.sessions(t.events, "ts", "12 hours", ["user_id"], F.count("*").alias("n"))
)
query("stream_first_of_key", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")(lambda t: windows.first_of_key(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts").select("user_id", "event_id"))
