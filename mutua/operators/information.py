"""Information estimators as aggregates. Natural logarithms unless a name says bits.

Every estimator counts label tuples with one grouped aggregate and works on the
counts, which are bounded by the labels, not by the rows. Smoothed estimates sum over
all cells of the joint table, but only cells that occur are stored: the others have
equal terms, which enter in closed form.
"""

from __future__ import annotations

from mutua.sqltext import Op


def pair_cells(lags: range | list[int]) -> str:
    """Counts of (a, b) for ordered pairs at each lag: b is ``lag`` ticks after a. A join on equal times."""
    shifted = ", ".join(f"({k})" for k in lags)
    return f"""
shifts AS (SELECT CAST(k AS INT) AS k FROM (VALUES {shifted}) AS v(k)),
early AS (SELECT trace_id, t + k AS at, var, bin, k FROM {{bins}} CROSS JOIN shifts),
cells AS (SELECT x.trace_id, x.var AS i, y.var AS j, x.k, x.bin AS a, y.bin AS b, count(*) AS n FROM early AS x JOIN {{bins}} AS y ON y.trace_id = x.trace_id AND y.t = x.at WHERE x.var <> y.var GROUP BY x.trace_id, x.var, y.var, x.k, x.bin, y.bin),
sides AS (SELECT *, sum(n) OVER (PARTITION BY trace_id, i, j, k, a) AS na, sum(n) OVER (PARTITION BY trace_id, i, j, k, b) AS nb, sum(n) OVER (PARTITION BY trace_id, i, j, k) AS total FROM cells),
mi AS (SELECT trace_id, i, j, k, greatest(0, sum(n * (ln(CAST(n AS DOUBLE)) + ln(CAST(total AS DOUBLE)) - ln(CAST(na AS DOUBLE)) - ln(CAST(nb AS DOUBLE))) / total)) AS mi FROM sides GROUP BY trace_id, i, j, k)"""


def lagged_mi(max_lag: int = 3) -> Op:
    """Plug-in mutual information of every ordered pair at every lag."""
    return Op(f"WITH {pair_cells(range(-max_lag, max_lag + 1))} SELECT trace_id, i, j, k AS lag, mi FROM mi")


def lag_max_mi(max_lag: int = 3) -> Op:
    """The largest mutual information over lags of either sign, for each unordered pair. Only lags from 0 up are joined: (i, j, -k) is (j, i, k)."""
    return Op(f"WITH {pair_cells(range(0, max_lag + 1))} SELECT trace_id, least(i, j) AS i, greatest(i, j) AS j, max(mi) AS mi FROM mi GROUP BY trace_id, least(i, j), greatest(i, j)")


#: Distance 1 - w / (largest w + 1e-12) from similarities (trace_id, i, j, w).
SIMILARITY_DISTANCE = Op("SELECT trace_id, i, j, w, 1 - w / (max(w) OVER (PARTITION BY trace_id) + 1e-12) AS distance FROM {similarity}")

#: Mutual information at equal times, and 1 for a variable with itself.
SYNC_MI = Op(f"WITH {pair_cells([0])} SELECT trace_id, i, j, mi AS w FROM mi UNION ALL SELECT DISTINCT trace_id, var, var, CAST(1 AS DOUBLE) FROM {{bins}}")


def _entropy_terms(alpha: float) -> str:
    """Smoothed conditional mutual information ``cmi`` (keys, cmi, n) from cells (keys, x, y, z, n).

    All marginals come from one pass over the cells; the rest is by keys, on one partitioning. Cells that never occur are added in closed form.
    """
    a = f"{alpha:e}"
    return f"""marginals AS (SELECT keys, concat(CASE WHEN grouping(x) = 0 THEN 'x' ELSE '' END, CASE WHEN grouping(y) = 0 THEN 'y' ELSE '' END, CASE WHEN grouping(z) = 0 THEN 'z' ELSE '' END) AS of, sum(n) AS m
  FROM cells GROUP BY GROUPING SETS ((keys, x, y, z), (keys, x, z), (keys, y, z), (keys, z), (keys, x), (keys, y))),
counted AS (SELECT keys, of, m, count_if(of = 'x') OVER w AS kx, count_if(of = 'y') OVER w AS ky, count_if(of = 'z') OVER w AS kz, sum(CASE WHEN of = 'xyz' THEN m ELSE 0 END) OVER w AS total FROM marginals WINDOW w AS (PARTITION BY keys)),
weighed AS (SELECT keys, of, m, total, total + {a} * kx * ky * kz AS d, CASE of WHEN 'xyz' THEN {a} WHEN 'z' THEN {a} * kx * ky WHEN 'xz' THEN {a} * ky ELSE {a} * kx END AS beta,
  CASE of WHEN 'xyz' THEN kx * ky * kz WHEN 'z' THEN kz WHEN 'xz' THEN kx * kz ELSE ky * kz END AS possible FROM counted WHERE of NOT IN ('x', 'y')),
entropies AS (SELECT keys, of, max(total) AS total, sum((m + beta) / d * ln((m + beta) / d)) + (max(possible) - count(*)) * max(beta / d) * ln(max(beta / d)) AS s FROM weighed GROUP BY keys, of),
cmi AS (SELECT keys, CASE WHEN max(total) < 10 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), sum(CASE WHEN of IN ('xyz', 'z') THEN s ELSE -s END)) END AS cmi, max(total) AS n FROM entropies GROUP BY keys)"""


def smoothed_cmi(alpha: float = 0.1) -> Op:
    """I(x; y | z) of observations (keys, x, y, z); labels are whatever the columns hold, joint ones included. 0 below 10 rows."""
    return Op(f"WITH cells AS (SELECT keys, x, y, z, count(*) AS n FROM {{observed}} GROUP BY keys, x, y, z), {_entropy_terms(alpha)} SELECT keys, cmi, n FROM cmi")


def smoothed_cmi_bits(alpha: float = 0.5) -> Op:
    return Op(f"WITH cells AS (SELECT keys, x, y, z, count(*) AS n FROM {{observed}} GROUP BY keys, x, y, z), {_entropy_terms(alpha)} SELECT keys, cmi / ln(CAST(2 AS DOUBLE)) AS cmi_bits, n FROM cmi")


#: Un-smoothed I(x; y | z), I(x; y) and entropies in bits, all groupings from one pass over the cells.
PLUGIN_BITS = Op("""
WITH cells AS (SELECT keys, x, y, z, count(*) AS n FROM {observed} GROUP BY keys, x, y, z),
g AS (SELECT keys, CASE WHEN grouping(x) = 0 THEN 'x' ELSE '' END AS gx, CASE WHEN grouping(y) = 0 THEN 'y' ELSE '' END AS gy, CASE WHEN grouping(z) = 0 THEN 'z' ELSE '' END AS gz, sum(n) AS m
  FROM cells GROUP BY GROUPING SETS ((keys, x, y, z), (keys, x, z), (keys, y, z), (keys, z), (keys, x, y), (keys, x), (keys, y))),
h AS (SELECT keys, concat(gx, gy, gz) AS of, ln(CAST(sum(m) AS DOUBLE)) / ln(CAST(2 AS DOUBLE)) - sum(m * ln(CAST(m AS DOUBLE))) / sum(m) / ln(CAST(2 AS DOUBLE)) AS bits FROM g GROUP BY keys, concat(gx, gy, gz))
SELECT keys, greatest(0, sum(CASE WHEN of IN ('xz', 'yz') THEN bits WHEN of IN ('xyz', 'z') THEN -bits ELSE 0 END)) AS cmi_bits,
  greatest(0, sum(CASE WHEN of IN ('x', 'y') THEN bits WHEN of = 'xy' THEN -bits ELSE 0 END)) AS mi_bits, max(CASE WHEN of = 'x' THEN bits END) AS entropy_x_bits
FROM h GROUP BY keys
""")

#: Plug-in I(x; y | z) in bits from joined count tables.
PLUGIN_CMI = Op("""
WITH c AS (SELECT keys, x, y, z, count(*) AS n FROM {observed} GROUP BY keys, x, y, z),
xz AS (SELECT keys, x, z, sum(n) AS n FROM c GROUP BY keys, x, z), yz AS (SELECT keys, y, z, sum(n) AS n FROM c GROUP BY keys, y, z),
zs AS (SELECT keys, z, sum(n) AS n FROM c GROUP BY keys, z), al AS (SELECT keys, sum(n) AS n FROM c GROUP BY keys)
SELECT c.keys, sum(CAST(c.n AS DOUBLE) / al.n * ln(CAST(c.n AS DOUBLE) * zs.n / (CAST(xz.n AS DOUBLE) * yz.n))) / ln(CAST(2 AS DOUBLE)) AS cmi_bits
FROM c JOIN xz ON xz.keys = c.keys AND xz.x = c.x AND xz.z = c.z JOIN yz ON yz.keys = c.keys AND yz.y = c.y AND yz.z = c.z JOIN zs ON zs.keys = c.keys AND zs.z = c.z JOIN al ON al.keys = c.keys
GROUP BY c.keys
""")

#: Shannon entropy of each variable's bins, in bits and nats, with 1e-12 inside the logarithm.
ENTROPY = Op("""
WITH p AS (SELECT trace_id, var, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY trace_id, var) AS p FROM {bins} GROUP BY trace_id, var, bin)
SELECT trace_id, var, -sum(p * ln(p + 1e-12)) / ln(CAST(2 AS DOUBLE)) AS bits, -sum(p * ln(p + 1e-12)) AS nats FROM p GROUP BY trace_id, var
""")

#: Entropy of each variable's rate of ones, 0 at rates 0 and 1.
BINARY_ENTROPY = Op("""
WITH p AS (SELECT trace_id, var, avg(CAST(x AS DOUBLE)) AS p FROM {binary} GROUP BY trace_id, var)
SELECT trace_id, var, p, CASE WHEN p <= 0 OR p >= 1 THEN CAST(0 AS DOUBLE) ELSE -p * ln(p) - (1 - p) * ln(1 - p) END AS nats FROM p
""")

#: Labels of joint states (trace_id, t, label), numbered in sorted order.
JOINT_LABELS = Op("""
WITH s AS (SELECT trace_id, t, JOINED(states, '') AS state FROM (SELECT trace_id, t, SETOF(concat(var, '=', CAST(x AS STRING), ';')) AS states FROM {binary} GROUP BY trace_id, t) AS g)
SELECT trace_id, t, state, dense_rank() OVER (PARTITION BY trace_id ORDER BY state) - 1 AS label FROM s
""")


def transfer_entropy(lag: int = 1, alpha: float = 0.1) -> Op:
    """I(y[t+lag]; x[t] | y[t]) for every ordered pair of a binary trace; smoothed."""
    return Op(f"""
WITH later AS (SELECT trace_id, t, var, x, lead(x, {lag}) OVER (PARTITION BY trace_id, var ORDER BY t) AS y1 FROM {{binary}}),
cells AS (SELECT concat(s.trace_id, '|', s.var, '|', d.var) AS keys, d.y1 AS x, s.x AS y, d.x AS z, count(*) AS n FROM later AS s JOIN later AS d ON d.trace_id = s.trace_id AND d.t = s.t
  WHERE s.var <> d.var AND d.y1 IS NOT NULL GROUP BY concat(s.trace_id, '|', s.var, '|', d.var), d.y1, s.x, d.x),
{_entropy_terms(alpha)}
SELECT keys AS pair, cmi AS te FROM cmi""")


def turned_transfer(shifts: int = 200, lag: int = 1, alpha: float = 0.1, both: bool = False) -> Op:
    """Transfer entropy into each variable turned by some ticks, from the others as they are: ``shifts`` null samples of each ordered pair. With ``both`` also out of it.

    A pair's key is trace:shift|source|target|turned. The offset is a hash of trace, shift and variable, from
    lag + 1 to n - lag - 2, so that only the variable's own sequence stays. The series of a trace have the same ticks, one after another.
    Values and the ones after them are paired before they are turned, so the samples need no sort.
    """
    out = """
  UNION ALL SELECT s.trace_id, s.shift, s.var, d.var, s.var, d.y1, s.x, d.x, count(*) FROM later AS s JOIN plain AS d ON d.trace_id = s.trace_id AND d.t = s.t WHERE s.var <> d.var AND d.y1 IS NOT NULL GROUP BY s.trace_id, s.shift, s.var, d.var, d.y1, s.x, d.x"""
    return Op(f"""
WITH span AS (SELECT trace_id, min(t) AS lo, max(t) - min(t) + 1 AS n FROM {{binary}} GROUP BY trace_id),
o AS (SELECT trace_id, var, lo, n, shift, {lag + 1} + HASHNO(concat(CAST(trace_id AS STRING), '|', var, '|', CAST(shift AS STRING))) % greatest(n - {2 * lag + 2}, 1) AS turn
  FROM (SELECT v.trace_id, v.var, lo, n, SEQ(1, {shifts}) AS shift FROM (SELECT DISTINCT trace_id, var FROM {{binary}}) AS v JOIN span ON span.trace_id = v.trace_id) AS e),
k AS (SELECT trace_id, var, t, x, row_number() OVER (PARTITION BY trace_id, var ORDER BY t) - 1 AS k FROM {{binary}}),
ring AS (SELECT a.trace_id, a.var, a.k, a.x, b.x AS y1 FROM k AS a JOIN span ON span.trace_id = a.trace_id JOIN k AS b ON b.trace_id = a.trace_id AND b.var = a.var AND b.k = (a.k + {lag}) % n),
later AS (SELECT r.trace_id, r.var, r.x, r.y1, o.shift, lo + (r.k + turn) % n AS t FROM ring AS r JOIN o ON o.trace_id = r.trace_id AND o.var = r.var WHERE (r.k + turn) % n < n - {lag}),
plain AS (SELECT trace_id, t, var, x, lead(x, {lag}) OVER (PARTITION BY trace_id, var ORDER BY t) AS y1 FROM {{binary}}),
pair_counts AS (SELECT d.trace_id, d.shift, s.var AS src, d.var AS dst, d.var AS of, d.y1 AS x, s.x AS y, d.x AS z, count(*) AS n FROM plain AS s JOIN later AS d ON d.trace_id = s.trace_id AND d.t = s.t
  WHERE s.var <> d.var AND d.y1 IS NOT NULL GROUP BY d.trace_id, d.shift, s.var, d.var, d.y1, s.x, d.x{out if both else ''}),
cells AS (SELECT concat(trace_id, ':', CAST(shift AS STRING), '|', src, '|', dst, '|', of) AS keys, x, y, z, n FROM pair_counts),
{_entropy_terms(alpha)}
SELECT keys AS pair, cmi AS te FROM cmi""")


def directed_information(length: int = 3, alpha: float = 1e-6) -> Op:
    """Massey's directed information over realisations (run, step, x, y) of ``length`` steps: sum over t of I(X up to t; Y at t | Y before t)."""
    return Op(f"""
WITH r AS (SELECT src, dst, run, step, x, y, {_prefix('x', length)} AS xs, {_prefix('y', length)} AS ys FROM {{runs}}),
cells AS (SELECT concat(src, '|', dst, '|', CAST(step AS STRING)) AS keys, xs AS x, y, substr(ys, 1, step) AS z, count(*) AS n FROM r GROUP BY concat(src, '|', dst, '|', CAST(step AS STRING)), xs, y, substr(ys, 1, step)),
{_entropy_terms(alpha)}
SELECT substr(keys, 1, length(keys) - 2) AS pair, sum(cmi) AS directed FROM cmi GROUP BY substr(keys, 1, length(keys) - 2)""")


def _prefix(c: str, length: int) -> str:
    parts = ", ".join(f"coalesce(CAST(lag({c}, {k}) OVER (PARTITION BY src, dst, run ORDER BY step) AS STRING), '')" for k in range(length - 1, 0, -1))
    return f"concat({parts}, CAST({c} AS STRING))"


#: Correlation of each pair at lag 1, the larger of both directions; 0 for a variable with itself.
LAGGED_CORRELATION = Op("""
WITH n AS (SELECT trace_id, t, var, value, lead(value) OVER (PARTITION BY trace_id, var ORDER BY t) AS later FROM {trace}),
c AS (SELECT a.trace_id, a.var AS i, b.var AS j, coalesce(CORR(a.value, b.later), CAST(0 AS DOUBLE)) AS r FROM n AS a JOIN n AS b ON b.trace_id = a.trace_id AND b.t = a.t WHERE a.var <> b.var GROUP BY a.trace_id, a.var, b.var)
SELECT trace_id, least(i, j) AS i, greatest(i, j) AS j, max(abs(r)) AS w FROM c GROUP BY trace_id, least(i, j), greatest(i, j)
""")

#: Correlation (past of i, future of j) with 1e-12 added to the deviations.
CROSS_CORRELATION = Op("""
WITH n AS (SELECT trace_id, t, var, value, lead(value) OVER (PARTITION BY trace_id, var ORDER BY t) AS later FROM {trace})
SELECT a.trace_id, a.var AS past, b.var AS future, covar_pop(a.value, b.later) / ((stddev_pop(a.value) + 1e-12) * (stddev_pop(b.later) + 1e-12)) AS r
FROM n AS a JOIN n AS b ON b.trace_id = a.trace_id AND b.t = a.t WHERE b.later IS NOT NULL GROUP BY a.trace_id, a.var, b.var
""")

#: Gaussian I(x; y | z) of each pair given a third variable: -ln(1 - r**2) / 2 with the partial correlation r.
SCALAR_GAUSSIAN_CMI = Op("""
WITH c AS (SELECT a.trace_id, a.var AS i, b.var AS j, CORR(a.value, b.value) AS r FROM {trace} AS a JOIN {trace} AS b ON b.trace_id = a.trace_id AND b.t = a.t WHERE a.var <> b.var GROUP BY a.trace_id, a.var, b.var),
p AS (SELECT ij.trace_id, ij.i, ij.j, ik.j AS given, (ij.r - ik.r * jk.r) / sqrt((1 - ik.r * ik.r) * (1 - jk.r * jk.r)) AS r FROM c AS ij JOIN c AS ik ON ik.trace_id = ij.trace_id AND ik.i = ij.i AND ik.j <> ij.j JOIN c AS jk ON jk.trace_id = ij.trace_id AND jk.i = ij.j AND jk.j = ik.j WHERE ij.i < ij.j)
SELECT trace_id, i, j, given, greatest(CAST(0 AS DOUBLE), -DBL(0.5) * ln(1 - r * r)) AS cmi FROM p
""")

#: Means over copies of a role, then the correlation of each role now with each role one tick later. ``variables`` has (var, agent, role).
ROLE_LAG_MATRIX = Op("""
WITH m AS (SELECT trace_id, agent, role, t, avg(value) AS v FROM {trace} JOIN {variables} USING (var) GROUP BY trace_id, agent, role, t),
n AS (SELECT *, lead(v) OVER (PARTITION BY trace_id, agent, role ORDER BY t) AS later FROM m)
SELECT a.trace_id, a.agent AS source_agent, a.role AS source_role, b.agent AS target_agent, b.role AS target_role, CORR(a.v, b.later) AS r
FROM n AS a JOIN n AS b ON b.trace_id = a.trace_id AND b.t = a.t WHERE a.role = 'action' AND b.role = 'sensor' GROUP BY a.trace_id, a.agent, a.role, b.agent, b.role
""")

CHANGE_RATE = Op("""
SELECT trace_id, var, avg(CAST(x <> before AS INT)) AS rate FROM (SELECT trace_id, var, x, lag(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS before FROM {binary}) AS c WHERE before IS NOT NULL GROUP BY trace_id, var
""")


def mechanism_agreement(noise: float = 0.02) -> Op:
    """How often y[t+1] differs from x[t] xor z[t], for ordered triples, and what flips of rate ``noise`` in three terms would give."""
    q = noise
    for _ in range(2):
        q = q * (1 - noise) + (1 - q) * noise
    return Op(f"""
WITH n AS (SELECT trace_id, t, var, x, lead(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS later FROM {{binary}})
SELECT a.trace_id, a.var AS i, b.var AS j, c.var AS target, avg(CAST(XOR(a.x, b.x) <> c.later AS INT)) AS disagreement, CAST({q!r} AS DOUBLE) AS predicted
FROM n AS a JOIN n AS b ON b.trace_id = a.trace_id AND b.t = a.t AND a.var < b.var JOIN n AS c ON c.trace_id = a.trace_id AND c.t = a.t AND c.var <> a.var AND c.var <> b.var
WHERE c.later IS NOT NULL GROUP BY a.trace_id, a.var, b.var, c.var""")
