"""The derivations of ``standins`` as SQL common table expressions for DuckDB."""

from __future__ import annotations

from agorametrics import fixed_values as fixed


def month_keys(ts: str) -> str:
    return f"CAST(year({ts}) AS INTEGER) AS year, CAST(month({ts}) AS INTEGER) AS month"


K = """CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT)"""

CHANNEL = """CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2
    WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT)"""

BLANK = f"NOT regexp_matches(content, '{fixed.NON_BLANK_PATTERN}')"
SHORT = "length(content) < 15"
LINK = "contains(content, 'http')"
EMOJI = f"regexp_matches(content, '{fixed.EMOJI_PATTERN}')"
TAG = f"regexp_matches(content, '{fixed.TAG_PATTERN}')"
VALID = f"(NOT ({SHORT}) AND NOT {LINK} AND NOT {EMOJI} AND NOT {TAG})"

CTES: dict[str, str] = {
    "event_stats": f"""
        SELECT user_id AS author_id, {month_keys("ts")}, count(*) AS total_messages,
               CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_reactions
        FROM events GROUP BY 1, 2, 3""",
    "event_edges": f"""
        SELECT user_id AS giver_id, {K} AS receiver_id, {month_keys("ts")},
               count(*) AS reaction_count
        FROM events GROUP BY 1, 2, 3, 4""",
    "event_reactions": """
        SELECT giver_id, receiver_id, CAST(sum(reaction_count) AS BIGINT) AS reaction_count
        FROM event_edges GROUP BY 1, 2""",
    "raw": f"""
        SELECT event_id AS id, {CHANNEL} AS channel_id, user_id AS author_id,
               'Member ' || user_id AS author_name, user_id < 5 AS author_bot,
               CASE WHEN k < 20 THEN 'clicked the item ' || props
                    WHEN k < 35 THEN 'see http://x.y for ' || props
                    WHEN k < 50 THEN 'thanks <@!42> for ' || props
                    WHEN k < 60 THEN 'so good <:pog:12> ' || props
                    WHEN k < 70 THEN chr(12288) || chr(9) || ' '
                    WHEN k < 80 THEN props
                    ELSE 'time is: now @home ' || props END AS content,
               ts AS created_at, CASE WHEN k > 0 THEN event_id - k END AS reply_to,
               k, CAST(floor(value / 20) AS BIGINT) AS ups,
               CAST(floor(value / 20) AS BIGINT) + 1 AS reaction_count
        FROM (SELECT *, {K} AS k FROM events)""",
    "readable": "SELECT DISTINCT channel_id FROM raw WHERE channel_id <> 2",
    "counted": f"SELECT * FROM raw WHERE NOT ({BLANK}) AND author_id <> 13",
    "settled": """
        SELECT * FROM counted JOIN readable USING (channel_id) WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR
            <= (SELECT max(created_at) - INTERVAL 1 DAY FROM raw)""",
    "scanned": """
        SELECT * FROM counted JOIN readable USING (channel_id)
        WHERE created_at < TIMESTAMP '2024-02-01 00:00:00'""",
    "members": """
        SELECT c_custkey AS id, c_mktsegment = 'MACHINERY' AS bot,
               CASE c_mktsegment WHEN 'BUILDING' THEN c_name || ' ' || chr(127881)
                    WHEN 'FURNITURE' THEN 'Ünï ' || c_name
                    WHEN 'HOUSEHOLD' THEN chr(128640) ELSE c_name END AS display_name
        FROM customer WHERE c_acctbal >= 0""",
    "mapping": f"""
        SELECT id AS author_id, regexp_replace(display_name,
               '{fixed.USERNAME_STRIP_PATTERN}', '', 'g') AS username
        FROM members""",
    "order_messages": """
        SELECT o_orderkey AS id, o_custkey AS author_id, o_orderdate AS ts,
               count(l_orderkey) AS reaction_count
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "order_stats": f"""
        SELECT author_id, {month_keys("ts")}, count(*) AS total_messages,
               CAST(sum(reaction_count) AS BIGINT) AS total_reactions
        FROM order_messages GROUP BY 1, 2, 3""",
    "order_edges": f"""
        SELECT l_suppkey AS giver_id, o_custkey AS receiver_id, {month_keys("o_orderdate")},
               count(*) AS reaction_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""",
    "order_reactions": """
        SELECT giver_id, receiver_id, CAST(sum(reaction_count) AS BIGINT) AS reaction_count
        FROM order_edges GROUP BY 1, 2""",
    "nation_reactions": """
        SELECT CAST(s_nationkey AS BIGINT) AS giver_id, CAST(c_nationkey AS BIGINT) AS receiver_id,
               CAST(sum(reaction_count) AS BIGINT) AS reaction_count
        FROM order_reactions JOIN supplier ON giver_id = s_suppkey
        JOIN customer ON receiver_id = c_custkey GROUP BY 1, 2""",
    "contents": """
        SELECT doc_id, CASE source WHEN 'src1' THEN text || ' <:pog:12>'
               WHEN 'src2' THEN '<@!42> ' || text WHEN 'src3' THEN text || ' http://x.y'
               WHEN 'src4' THEN text || ' HTTP://X.Y' WHEN 'src5' THEN text || ' <a:wave:1>'
               WHEN 'src6' THEN '<@' || chr(10) || '> ' || text
               WHEN 'src7' THEN '<@' || chr(13) || '> ' || text
               WHEN 'src8' THEN text || ' <:x:1,a>' WHEN 'src9' THEN '<@&7> ' || text
               ELSE text END AS content
        FROM documents""",
    "order_contents": """
        SELECT id, author_id, ts, reaction_count, coalesce(content, '') AS content
        FROM order_messages LEFT JOIN contents ON doc_id = id""",
    "order_quality": f"""
        SELECT * FROM order_contents
        WHERE NOT ({BLANK}) AND reaction_count >= 4 AND {VALID}""",
    "turns": """
        SELECT conv_id * 100000 + turn AS id, nullif(role, 'system') AS author_name,
               CASE WHEN role <> 'system' THEN text END AS content,
               CASE WHEN role = 'system' THEN conv_id * 100000 + 99999
                    WHEN turn > 0 THEN conv_id * 100000 + turn - 1 END AS reply_to
        FROM conversations""",
    # The month of the most-liked report: edges between mapped, writing users.
    "liked_rows": """
        SELECT e.giver_id, e.receiver_id, g.username AS giver_username,
               r.username AS receiver_username, e.reaction_count / 50.0 AS weight
        FROM event_edges e
        JOIN mapping g ON e.giver_id = g.author_id
        JOIN mapping r ON e.receiver_id = r.author_id
        JOIN event_stats gs ON e.giver_id = gs.author_id AND e.year = gs.year AND e.month = gs.month
        JOIN event_stats rs ON e.receiver_id = rs.author_id AND e.year = rs.year AND e.month = rs.month
        WHERE e.year = 2024 AND e.month = 1""",
    "liked_edges": """
        SELECT least(giver_username, receiver_username) AS u,
               greatest(giver_username, receiver_username) AS v,
               last(weight ORDER BY giver_id, receiver_id) AS weight
        FROM liked_rows
        WHERE giver_username <> receiver_username
          AND weight >= (SELECT quantile_cont(weight, 0.8) FROM liked_rows)
        GROUP BY 1, 2""",
    "monthly_rpm": """
        SELECT year, month, avg(CAST(total_reactions AS DOUBLE) / nullif(total_messages, 0)) AS average_rpm
        FROM order_stats GROUP BY 1, 2""",
    "yearly_rpm": """
        SELECT year, CAST(sum(total_reactions) AS BIGINT) AS total_reactions,
               CAST(sum(total_messages) AS BIGINT) AS total_messages,
               CAST(sum(total_reactions) AS DOUBLE) / nullif(sum(total_messages), 0) AS average_rpm
        FROM order_stats GROUP BY 1""",
    "yearly_change": """
        SELECT * FROM (
            SELECT *, lag(average_rpm) OVER (ORDER BY year) AS previous FROM yearly_rpm)
        WHERE previous IS NOT NULL""",
    "trade_edges": """
        SELECT * FROM order_edges WHERE year > 1998 OR (year = 1998 AND month >= 3)""",
    "spine": """
        SELECT id AS author_id, CAST(step AS INTEGER) AS step,
               CAST(DATE '1999-01-31' - CAST(step * 30 AS INTEGER) AS DATE) AS day
        FROM members, unnest(range(12)) AS s(step)""",
    "personal": """
        SELECT sp.author_id, step, CAST(year(day) AS INTEGER) AS year,
               CAST(month(day) AS INTEGER) AS month, strftime(day, '%b %Y') AS month_name,
               coalesce(total_messages, 0) AS total_msgs, coalesce(total_reactions, 0) AS total_reacts,
               coalesce(CAST(total_reactions AS DOUBLE) / nullif(total_messages, 0), 0.0) AS avg_reacts
        FROM spine sp LEFT JOIN order_stats s ON sp.author_id = s.author_id
             AND year(day) = s.year AND month(day) = s.month""",
    "active": """
        SELECT author_id FROM event_stats
        WHERE year = 2024 AND month = 1 AND total_messages >= 60""",
    "cells": """
        SELECT giver_id, receiver_id, reaction_count FROM event_reactions
        WHERE giver_id IN (SELECT author_id FROM active)
          AND receiver_id IN (SELECT author_id FROM active)""",
}

_DEPENDS = {
    "event_reactions": ["event_edges"],
    "readable": ["raw"],
    "counted": ["raw"],
    "settled": ["counted", "readable"],
    "scanned": ["counted", "readable"],
    "mapping": ["members"],
    "order_stats": ["order_messages"],
    "order_reactions": ["order_edges"],
    "nation_reactions": ["order_reactions"],
    "order_contents": ["order_messages", "contents"],
    "order_quality": ["order_contents"],
    "liked_rows": ["event_edges", "event_stats", "mapping"],
    "liked_edges": ["liked_rows"],
    "monthly_rpm": ["order_stats"],
    "yearly_rpm": ["order_stats"],
    "yearly_change": ["yearly_rpm"],
    "trade_edges": ["order_edges"],
    "spine": ["members"],
    "personal": ["spine", "order_stats"],
    "active": ["event_stats"],
    "cells": ["event_reactions", "active"],
}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``body`` below the named common table expressions and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    joiner = ",\n" if recursive and ordered else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{joiner}{body}"
