"""More web-analytics shapes: filters, string groups, top lists and time buckets over events, pages and documents."""

from __future__ import annotations

from tallyforge.plans.registry import same

same("web_many_sums", "SELECT " + ", ".join(f"round(sum(value + {k}), 4) AS s{k}" for k in range(12)) + " FROM events")
same("web_top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
same("web_distinct_per_type", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS v, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
same("web_user_hours", "SELECT user_id, CAST(extract(HOUR FROM ts) AS BIGINT) AS h, event_type, count(*) AS n FROM events GROUP BY user_id, extract(HOUR FROM ts), event_type ORDER BY n DESC, user_id, h, event_type LIMIT 10")
same("web_contains_not", "SELECT count(*) AS n FROM pages WHERE html LIKE '%track%' AND url NOT LIKE '%.org%' AND url <> ''")
same("web_first_text", "SELECT lang, min(left(text, 20)) AS first_text, min(source) AS s, count(*) AS n FROM documents WHERE text LIKE '%a%' AND lang <> 'en' GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
same("web_order_by_time", "SELECT event_id, props FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 10")
same("web_order_two_keys", "SELECT event_type, event_id FROM events WHERE value > 0 ORDER BY event_type, ts, event_id LIMIT 10")
same("web_shifted_keys", "SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY n DESC, user_id LIMIT 10")
same("web_constant_key", "SELECT 1 AS one, event_type, count(*) AS n FROM events GROUP BY 1, event_type ORDER BY n DESC, event_type LIMIT 10")
same("web_day_range", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts <= TIMESTAMP_NTZ '2024-01-20 00:00:00' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
same("web_page_of_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10 OFFSET 20")
same("web_case_source", "SELECT CASE WHEN event_type = 'view' AND value < 50 THEN 'low' ELSE '' END AS src, event_type AS dst, count(*) AS n FROM events GROUP BY CASE WHEN event_type = 'view' AND value < 50 THEN 'low' ELSE '' END, event_type ORDER BY n DESC, src, dst LIMIT 10")
same("web_host", "SELECT host, count(*) AS n, avg(CAST(length(url) AS DOUBLE)) AS l, min(url) AS u FROM (SELECT url, regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages) AS p WHERE host <> '' GROUP BY host ORDER BY n DESC, host LIMIT 25")
same("web_turns", "SELECT role, count(*) AS n, max(turn) AS longest, count(DISTINCT conv_id) AS c FROM conversations GROUP BY role")
same("web_labels", "SELECT source, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS bad, count(*) AS n FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source")
