"""Evaluation of partitions and rankings, pooling over traces, and summaries."""

from __future__ import annotations

from mutua.sqltext import Op

#: Adjusted Rand index of two labellings (grp, a, b); 0 below two rows or without pairs to agree on.
ADJUSTED_RAND = Op("""
WITH c AS (SELECT grp, a, b, CAST(count(*) AS DOUBLE) AS n FROM {labelled} GROUP BY grp, a, b),
ra AS (SELECT grp, sum(n * (n - 1) / 2) AS s FROM (SELECT grp, a, sum(n) AS n FROM c GROUP BY grp, a) AS x GROUP BY grp),
rb AS (SELECT grp, sum(n * (n - 1) / 2) AS s FROM (SELECT grp, b, sum(n) AS n FROM c GROUP BY grp, b) AS x GROUP BY grp),
t AS (SELECT grp, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS total FROM c GROUP BY grp)
SELECT t.grp, CASE WHEN total = 0 OR (ra.s + rb.s) / 2 = ra.s * rb.s / total THEN CAST(0 AS DOUBLE) ELSE (t.s - ra.s * rb.s / total) / ((ra.s + rb.s) / 2 - ra.s * rb.s / total) END AS ari FROM t JOIN ra ON ra.grp = t.grp JOIN rb ON rb.grp = t.grp
""")

#: For each predicted cluster the best Jaccard similarity with a true one, averaged, and the share of true ones that are some cluster's best.
BEST_JACCARD = Op("""
WITH c AS (SELECT grp, a, b, count(*) AS n FROM {labelled} GROUP BY grp, a, b), na AS (SELECT grp, a, sum(n) AS n FROM c GROUP BY grp, a), nb AS (SELECT grp, b, sum(n) AS n FROM c GROUP BY grp, b),
j AS (SELECT c.grp, c.a, c.b, c.n / CAST(na.n + nb.n - c.n AS DOUBLE) AS jaccard FROM c JOIN na ON na.grp = c.grp AND na.a = c.a JOIN nb ON nb.grp = c.grp AND nb.b = c.b),
m AS (SELECT grp, a, b, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY grp, a ORDER BY round(jaccard, 9) DESC, b) AS place FROM j) AS r WHERE place = 1)
SELECT m.grp, avg(jaccard) AS mean_jaccard, count(DISTINCT m.b) / CAST(max(k.n) AS DOUBLE) AS recall FROM m JOIN (SELECT grp, count(DISTINCT b) AS n FROM {labelled} GROUP BY grp) AS k ON k.grp = m.grp GROUP BY m.grp
""")

#: Majority label of each cluster, its share, the share of rows of label -1, and entropy of labels.
CLUSTER_PURITY = Op("""
WITH c AS (SELECT grp, a, b, count(*) AS n FROM {labelled} GROUP BY grp, a, b), s AS (SELECT *, sum(n) OVER (PARTITION BY grp, a) AS total, row_number() OVER (PARTITION BY grp, a ORDER BY n DESC, b) AS place FROM c)
SELECT grp, a, max(CASE WHEN place = 1 THEN b END) AS majority, max(n) / CAST(max(total) AS DOUBLE) AS purity, max(total) AS size, -sum(n / CAST(total AS DOUBLE) * ln(n / CAST(total AS DOUBLE))) AS label_entropy FROM s GROUP BY grp, a
""")


def recall_at(k: int = 3) -> Op:
    """Share of relevant items among the ``k`` best of each group, and precision. ``ranked`` has (grp, item, score, relevant)."""
    return Op(f"""
WITH r AS (SELECT grp, relevant, row_number() OVER (PARTITION BY grp ORDER BY score DESC, item) AS place FROM {{ranked}})
SELECT grp, count_if(relevant AND place <= {k}) / CAST(greatest(1, count_if(relevant)) AS DOUBLE) AS recall, count_if(relevant AND place <= {k}) / CAST({k} AS DOUBLE) AS prec, min(CASE WHEN relevant THEN place END) AS first_place FROM r GROUP BY grp""")


#: Mean, pass rate, median z and Fisher's combined p over groups of tests (grp, p, z). -2 sum ln p has 2n degrees of freedom, an even number, so its tail is a finite sum.
FISHER_POOL = Op("""
WITH s AS (SELECT grp, count(*) AS n, -sum(ln(greatest(p, 1e-12))) AS half, avg(p) AS mean_p, avg(CAST(p < DBL(0.05) AS INT)) AS pass_rate, PCT(z, 0.5) AS median_z FROM {tests} GROUP BY grp),
t AS (SELECT grp, n, half, mean_p, pass_rate, median_z, SEQ(CAST(1 AS BIGINT), n) AS k FROM s),
l AS (SELECT *, CASE WHEN k = 1 THEN CAST(0 AS DOUBLE) WHEN half > 0 THEN (k - 1) * ln(greatest(half, 1e-300)) - sum(ln(CAST(greatest(k - 1, 1) AS DOUBLE))) OVER (PARTITION BY grp ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS term FROM t)
SELECT grp, n, mean_p, pass_rate, median_z, least(CAST(1 AS DOUBLE), sum(exp(term - half))) AS combined_p FROM l GROUP BY grp, n, mean_p, pass_rate, median_z
""")

#: Each group against the mean of all others.
LEAVE_ONE_OUT = Op("""
WITH g AS (SELECT grp, sum(score) AS s, count(*) AS n, avg(score) AS own FROM {scores} GROUP BY grp), a AS (SELECT sum(s) AS s, sum(n) AS n FROM g)
SELECT grp, own, (a.s - g.s) / nullif(a.n - g.n, 0) AS others, own - (a.s - g.s) / nullif(a.n - g.n, 0) AS gap FROM g JOIN a ON true
""")

SUMMARY = Op("SELECT grp, avg(score) AS mean, stddev_pop(score) AS sd, PCT(score, 0.5) AS middle, count(*) AS n FROM {scores} GROUP BY grp")


def breaking_point(edge: float) -> Op:
    """The first size at which the metric is under the edge. ``curve`` has (grp, size, metric)."""
    return Op(f"SELECT grp, min(CASE WHEN metric < {edge:e} THEN size END) AS breaks_at, max(metric) AS most FROM {{curve}} GROUP BY grp")


#: Verdict of each group, rates over groups, and a line of text.
VERDICTS = Op("""
WITH v AS (SELECT grp, avg(score) AS mean, bool_and(score >= 0) AS never_negative FROM {scores} GROUP BY grp)
SELECT grp, never_negative, concat(CASE WHEN never_negative THEN 'PASS' ELSE 'FAIL' END, ' ', CAST(CAST(round(mean) AS BIGINT) AS STRING)) AS memo FROM v
""")

#: Counts over all groupings of two keys at once.
CUBE = Op("SELECT coalesce(a, 'all') AS a, coalesce(b, 'all') AS b, count(*) AS n, sum(v) AS total FROM {rows} GROUP BY CUBE (a, b)")

#: The first record of each id by arrival.
FIRST_RECORD = Op("SELECT id, arrival, payload FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) AS place FROM {records}) AS r WHERE place = 1")

#: Numbers in JSON text, with a default where they are missing.
JSON_FIELD = Op("SELECT event_id, coalesce(JSONINT(props, 'k'), -1) AS k, coalesce(JSONINT(props, 'missing'), -1) AS missing FROM {events}")

#: Validation of a trace: rows, repeated instants, nulls and values that are not finite.
VALIDATE = Op("""
SELECT trace_id, count(*) AS n, count(*) - count(DISTINCT concat(CAST(t AS STRING), '|', var)) AS repeats, count_if(value IS NULL) AS n_null, count_if(value <> value OR abs(value) > 1e300) AS n_odd, max(t) - min(t) + 1 = count(DISTINCT t) AS dense FROM {trace} GROUP BY trace_id
""")

#: Edges as lines of a graph file.
DOT_LINES = Op("SELECT trace_id, concat('\"', i, '\" -- \"', j, '\" [weight=', CAST(CAST(round(w * 1000000) AS BIGINT) AS STRING), '];') AS line FROM {similarity}")


def widen(variables: list[str]) -> Op:
    """A fixed list of variables side by side."""
    return Op("SELECT trace_id, t, " + ", ".join(f"max(CASE WHEN var = '{v}' THEN value END) AS {v}_value" for v in variables) + " FROM {trace} GROUP BY trace_id, t")


#: Traces of several recordings on one clock: shorter ones hold their last value. ``trace`` is joined with its spine.
PAD_ALIGNED = Op("""
WITH n AS (SELECT trace_id, var, max(t) AS last_t, max_by(value, t) AS last_value FROM {trace} GROUP BY trace_id, var), m AS (SELECT max(last_t) AS t FROM n),
extra AS (SELECT trace_id, var, SEQ(last_t + 1, to_t) AS t, last_value AS value FROM (SELECT n.*, m.t AS to_t FROM n JOIN m ON true WHERE m.t > n.last_t) AS e)
SELECT trace_id, var, t, value FROM {trace} UNION ALL SELECT trace_id, var, t, value FROM extra
""")
