"""Windows, runs of activity and episodes."""

from __future__ import annotations

from mutua.sqltext import Op


def active_runs(least: int = 2) -> Op:
    """Runs of consecutive active ticks, of ``least`` at least. ``mask`` has (trace_id, t, active)."""
    return Op(f"""
WITH r AS (SELECT trace_id, t, active, row_number() OVER (PARTITION BY trace_id ORDER BY t) - row_number() OVER (PARTITION BY trace_id, active ORDER BY t) AS island FROM {{mask}})
SELECT trace_id, min(t) AS start_t, max(t) + 1 AS end_t, count(*) AS n FROM r WHERE active GROUP BY trace_id, island HAVING count(*) >= {least}""")


def sliding_segments(width: int, step: int, least: int = 2) -> Op:
    """Sliding windows and active runs, runs shorter than the width widened at their end, each once."""
    return Op(f"""
WITH n AS (SELECT trace_id, max(t) + 1 AS n FROM {{mask}} GROUP BY trace_id),
w AS (SELECT trace_id, k * {step} AS start_t, least(k * {step} + {width}, n) AS end_t FROM (SELECT trace_id, n, SEQ(CAST(0 AS BIGINT), DIV(greatest(n - {width}, 0), {step})) AS k FROM n) AS e),
r AS (SELECT trace_id, t, active, row_number() OVER (PARTITION BY trace_id ORDER BY t) - row_number() OVER (PARTITION BY trace_id, active ORDER BY t) AS island FROM {{mask}}),
a AS (SELECT trace_id, min(t) AS start_t, max(t) + 1 AS end_t FROM r WHERE active GROUP BY trace_id, island HAVING count(*) >= {least})
SELECT trace_id, start_t, end_t FROM w UNION SELECT a.trace_id, start_t, least(greatest(end_t, start_t + {width}), n) FROM a JOIN n ON n.trace_id = a.trace_id""")


#: Window length T / 6 between 80 and 300, step and least run from it, and the coefficient of the activity threshold: smaller for sparse activity, null (no mask) for constant activity.
SEGMENT_PARAMETERS = Op("""
WITH m AS (SELECT trace_id, PCT(value, 0.5) AS mid FROM {activity} GROUP BY trace_id),
s AS (SELECT trace_id, count(*) AS n, avg(abs(value)) AS size, stddev_pop(value) AS sd, avg(CASE WHEN value > mid THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS share FROM {activity} JOIN m USING (trace_id) GROUP BY trace_id),
w AS (SELECT *, least(300, greatest(80, DIV(n, 6))) AS width FROM s)
SELECT trace_id, CAST(width AS INT) AS width, CAST(greatest(DIV(width, 2), 20) AS INT) AS step, CAST(greatest(40, least(DIV(width, 2), 120)) AS INT) AS least_run,
  CASE WHEN size >= 1e-6 AND sd / (size + 1e-6) >= DBL(0.08) THEN DBL(0.15) + DBL(0.45) * (1 - share) END AS coefficient FROM w
""")


def should_segment(ticks: int = 250, least_share: float = 0.22, middle_share: float = 0.40) -> Op:
    """Whether a long trace has a clearly sparse agent and low activity in the middle. ``activity`` has (trace_id, agent, t, value).

    An agent is active above its median and a quarter deviation; always where its activity is constant, never where it is none.
    """
    return Op(f"""
WITH m AS (SELECT trace_id, agent, PCT(value, 0.5) AS mid, avg(abs(value)) AS size, stddev_pop(value) AS sd, count(*) AS n FROM {{activity}} GROUP BY trace_id, agent),
a AS (SELECT trace_id, agent, max(n) AS n, CASE WHEN max(size) < 1e-6 THEN CAST(0 AS DOUBLE) WHEN max(sd) / (max(size) + 1e-6) < DBL(0.08) THEN CAST(1 AS DOUBLE) ELSE avg(CASE WHEN value > mid + DBL(0.25) * sd THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END AS share FROM {{activity}} JOIN m USING (trace_id, agent) GROUP BY trace_id, agent)
SELECT trace_id, min(share) AS least_share, PCT(share, 0.5) AS middle_share, max(n) >= {ticks} AND min(share) < {least_share:e} AND PCT(share, 0.5) < {middle_share:e} AS segment FROM a GROUP BY trace_id""")


def episode_mask(period: int = 80, length: int = 12) -> Op:
    """On for ``length`` of each ``period`` ticks, later by an offset for each agent. ``agents`` has (agent, t)."""
    return Op(f"SELECT agent, t, (t + {period} - (agent * 7) % {period}) % {period} < {length} AS on_air FROM {{agents}}")


def window_majority(width: int = 32) -> Op:
    """At every ``width``-th tick, whether most of the ticks before were ones."""
    return Op(f"""
SELECT trace_id, t, var, CAST(share > DBL(0.5) AS INT) AS meter FROM (SELECT trace_id, t, var, avg(CAST(x AS DOUBLE)) OVER (PARTITION BY trace_id, var ORDER BY t ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING) AS share FROM {{binary}}) AS w WHERE t % {width} = 0 AND share IS NOT NULL""")


#: Which variable leads at each tick, and how often the leader stays.
WINNER_PERSISTENCE = Op("""
WITH w AS (SELECT trace_id, t, var FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, t ORDER BY value DESC, var) AS place FROM {trace}) AS r WHERE place = 1),
n AS (SELECT trace_id, var, lag(var) OVER (PARTITION BY trace_id ORDER BY t) AS before FROM w)
SELECT trace_id, avg(CAST(var = before AS INT)) AS stays, count(before) AS n FROM n GROUP BY trace_id
""")


def rank_within(top: int = 3) -> Op:
    """The ``top`` ticks of each series by value, ties by time."""
    return Op(f"SELECT trace_id, var, t, value, place FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, var ORDER BY value DESC, t) AS place FROM {{trace}}) AS r WHERE place <= {top}")


def sessions(gap_hours: int = 6) -> Op:
    """Sessions of each user: a new one after ``gap_hours`` without events."""
    return Op(f"""
WITH g AS (SELECT trace_id, HOURNO(ts) AS h, value, lag(HOURNO(ts)) OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS before, event_id, ts FROM {{users}}),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR h - before >= {gap_hours} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT trace_id, session, min(h) AS first_hour, max(h) AS last_hour, count(*) AS n, sum(value) AS total FROM s GROUP BY trace_id, session""")


def range_join() -> Op:
    """Events within segments, through the hours that each segment covers: an equi-join, not a range of all pairs."""
    return Op("""
WITH c AS (SELECT trace_id, start_t, end_t, SEQ(start_t, end_t - 1) AS t FROM {segments})
SELECT c.trace_id, c.start_t, c.end_t, v.var, count(*) AS n, sum(v.value) AS total, max(v.value) AS most FROM c JOIN {trace} AS v ON v.trace_id = c.trace_id AND v.t = c.t GROUP BY c.trace_id, c.start_t, c.end_t, v.var""")


#: Each user's event with the latest error before it: an as-of join by a window over both kinds of row.
AS_OF = Op("""
SELECT trace_id, t, value, last_error_t, last_error_value FROM (SELECT trace_id, t, event_type, value, max(CASE WHEN event_type = 'error' THEN t END) OVER w AS last_error_t, max_by(value, CASE WHEN event_type = 'error' THEN t END) OVER w AS last_error_value
  FROM {users} WINDOW w AS (PARTITION BY trace_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS a WHERE event_type <> 'error'
""")
