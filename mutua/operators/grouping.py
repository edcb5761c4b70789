"""Clusters of variables: pruning, scores, fusion of parts, matching with known groups.

Inputs: ``similarity`` (trace_id, i, j, w) with i < j, ``labels`` (trace_id, var, cluster).
"""

from __future__ import annotations

from mutua.sqltext import Op

BOTH = "both_ways AS (SELECT trace_id, i, j, w FROM {similarity} UNION ALL SELECT trace_id, j, i, w FROM {similarity})"


def weak_members(threshold: float = 0.5) -> Op:
    """Members whose mean similarity within the cluster is under ``threshold`` times the cluster's mean; clusters of one member vanish."""
    return Op(f"""
WITH {BOTH},
inner_pairs AS (SELECT a.trace_id, a.cluster, a.var, sum(w) AS row_sum, count(*) AS others FROM {{labels}} AS a JOIN both_ways AS p ON p.trace_id = a.trace_id AND p.i = a.var JOIN {{labels}} AS b ON b.trace_id = a.trace_id AND b.var = p.j AND b.cluster = a.cluster GROUP BY a.trace_id, a.cluster, a.var),
means AS (SELECT *, row_sum / others AS mean_w, avg(row_sum / others) OVER (PARTITION BY trace_id, cluster) AS cluster_mean FROM inner_pairs)
SELECT trace_id, cluster, var, mean_w, cluster_mean, mean_w < {threshold} * cluster_mean AS weak FROM means""")


def mdl_score(weight: float = 0.05) -> Op:
    """For each number of clusters k of ``cuts`` (trace_id, k, var, cluster): mean similarity within, less ``weight`` k ln(max(n, 2)), and the best k."""
    return Op(f"""
WITH inside AS (SELECT a.trace_id, a.k, avg(w) AS within FROM {{cuts}} AS a JOIN {{similarity}} AS p ON p.trace_id = a.trace_id AND p.i = a.var JOIN {{cuts}} AS b ON b.trace_id = a.trace_id AND b.k = a.k AND b.var = p.j AND b.cluster = a.cluster GROUP BY a.trace_id, a.k),
sizes AS (SELECT trace_id, k, count(DISTINCT var) AS n FROM {{cuts}} GROUP BY trace_id, k),
s AS (SELECT trace_id, k, coalesce(within, CAST(0 AS DOUBLE)) AS within, coalesce(within, CAST(0 AS DOUBLE)) - {weight:e} * k * ln(CAST(greatest(n, 2) AS DOUBLE)) AS score FROM sizes LEFT JOIN inside USING (trace_id, k))
SELECT trace_id, k, within, score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, k) = 1 AS best FROM s""")


#: Mean of each cluster and of all other variables, as two series of one trace per cluster.
CLUSTER_SERIES = Op("""
WITH m AS (SELECT trace_id, t, var, value, cluster FROM {trace} JOIN {labels} USING (trace_id, var)),
k AS (SELECT DISTINCT trace_id, cluster FROM {labels})
SELECT concat(m.trace_id, '|', CAST(k.cluster AS STRING)) AS trace_id, m.t, CASE WHEN m.cluster = k.cluster THEN 'own' ELSE 'rest' END AS var, avg(m.value) AS value
FROM m JOIN k ON k.trace_id = m.trace_id GROUP BY m.trace_id, k.cluster, m.t, CASE WHEN m.cluster = k.cluster THEN 'own' ELSE 'rest' END
""")

def precursor_stats(persistence: float = 0.12, contingency: float = 0.015) -> Op:
    """Persistence, contingency, richness and size of each cluster from its series' autocorrelation, pair information and entropy; passes with two members and both floors."""
    return Op(f"""
SELECT a.trace_id, a.paired AS persistence, m.mi AS contingency, e.nats AS richness, s.n AS size, s.n >= 2 AND a.paired >= {persistence:e} AND m.mi >= {contingency:e} AS passes
FROM {{autocorrelation}} AS a JOIN {{information}} AS m ON m.trace_id = a.trace_id JOIN {{entropy}} AS e ON e.trace_id = a.trace_id AND e.var = 'own'
JOIN (SELECT concat(trace_id, '|', CAST(cluster AS STRING)) AS trace_id, count(*) AS n FROM {{labels}} GROUP BY trace_id, cluster) AS s ON s.trace_id = a.trace_id WHERE a.var = 'own'""")


#: The trace of a cluster's series.
_TRACE_OF = "regexp_replace(trace_id, '[|][^|]*$', '')"


def cluster_rank(by_size: bool = False, within_weight: float = 0.3, tiny: float = 0.25) -> Op:
    """Clusters of each trace, best first: persistence above 0, contingency and similarity within, times the root of the size if asked; small ones count a part. Less ``penalties`` (trace_id, penalty), of the roles that they lack."""
    root = " * sqrt(size)" if by_size else ""
    return Op(f"""
WITH inside AS (SELECT concat(a.trace_id, '|', CAST(a.cluster AS STRING)) AS trace_id, avg(w) AS within FROM {{labels}} AS a JOIN {{similarity}} AS p ON p.trace_id = a.trace_id AND p.i = a.var JOIN {{labels}} AS b ON b.trace_id = a.trace_id AND b.var = p.j AND b.cluster = a.cluster GROUP BY a.trace_id, a.cluster),
s AS (SELECT trace_id, (greatest(persistence, CAST(0 AS DOUBLE)) + contingency + {within_weight:e} * coalesce(within, CAST(0 AS DOUBLE))){root} * CASE WHEN size <= 2 THEN {tiny:e} ELSE 1 END - coalesce(penalty, CAST(0 AS DOUBLE)) AS score FROM {{stats}} LEFT JOIN inside USING (trace_id) LEFT JOIN {{penalties}} USING (trace_id))
SELECT trace_id, score, row_number() OVER (PARTITION BY {_TRACE_OF} ORDER BY round(score, 9) DESC, trace_id) AS place FROM s""")


#: Pass rate times the mean signal (persistence and contingency) of the clusters that pass, and a little for every cluster.
PARTITION_SCORE = Op(f"""
SELECT {_TRACE_OF} AS trace_id, avg(CAST(passes AS INT)) AS pass_rate, coalesce(avg(CASE WHEN passes THEN persistence + contingency END), CAST(0 AS DOUBLE)) AS mean_signal, count(*) AS n,
  avg(CAST(passes AS INT)) * (coalesce(avg(CASE WHEN passes THEN persistence + contingency END), CAST(0 AS DOUBLE)) + 1e-6) + DBL(0.02) * count(*) AS score FROM {{stats}} GROUP BY {_TRACE_OF}
""")


def fusion_edges(threshold: float = 0.0) -> Op:
    """Pairs of chunks (chunk, trace_id, var) whose mean cross similarity is over the threshold; a variable that both hold counts with itself as the largest similarity."""
    return Op(f"""
WITH {BOTH},
self AS (SELECT trace_id, max(w) AS w FROM {{similarity}} GROUP BY trace_id),
crossed AS (
  SELECT a.trace_id, a.chunk AS a, b.chunk AS b, p.w FROM {{chunks}} AS a JOIN both_ways AS p ON p.trace_id = a.trace_id AND p.i = a.var JOIN {{chunks}} AS b ON b.trace_id = a.trace_id AND b.var = p.j AND b.chunk > a.chunk
  UNION ALL SELECT a.trace_id, a.chunk, b.chunk, self.w FROM {{chunks}} AS a JOIN {{chunks}} AS b ON b.trace_id = a.trace_id AND b.var = a.var AND b.chunk > a.chunk JOIN self ON self.trace_id = a.trace_id)
SELECT trace_id, a, b, avg(w) AS weight, count(*) AS pairs FROM crossed GROUP BY trace_id, a, b HAVING avg(w) > {threshold}""")


#: Each found set with its best known one by shared items (-1 if it shares none): recall, share of others, clean when nothing else is in it.
PURITY_MATCH = Op("""
WITH f AS (SELECT owner, item FROM {found}), k AS (SELECT owner AS known, item FROM {known}),
hits AS (SELECT owner, known, count(*) AS shared FROM f JOIN k USING (item) GROUP BY owner, known),
fs AS (SELECT owner, count(*) AS n FROM f GROUP BY owner), ks AS (SELECT known, count(*) AS n FROM k GROUP BY known),
r AS (SELECT h.owner, h.known, h.shared, fs.n AS size, ks.n AS known_size, row_number() OVER (PARTITION BY h.owner ORDER BY CAST(h.shared AS DOUBLE) / (fs.n + ks.n - h.shared) DESC, h.known) AS place FROM hits AS h JOIN fs ON fs.owner = h.owner JOIN ks ON ks.known = h.known)
SELECT fs.owner, coalesce(known, -1) AS known, coalesce(CAST(shared AS DOUBLE) / known_size, CAST(0 AS DOUBLE)) AS recall, CAST(fs.n - coalesce(shared, 0) AS DOUBLE) / fs.n AS extra, coalesce(shared, 0) = fs.n AS clean FROM fs LEFT JOIN (SELECT * FROM r WHERE place = 1) AS b ON b.owner = fs.owner
""")

#: Kind of each cluster by the agents of its variables (agent < 0 is the world).
CLUSTER_KIND = Op("""
SELECT trace_id, cluster, count(*) AS size, count_if(agent >= 0) AS n_agent, count_if(agent < 0) AS n_world,
  CASE WHEN count_if(agent < 0) = 0 THEN 'agent' WHEN count_if(agent >= 0) = 0 THEN 'world' ELSE 'mixed' END AS kind
FROM {labels} JOIN {variables} USING (var) GROUP BY trace_id, cluster
""")


def compress_block(budget: int = 4) -> Op:
    """Joint states (trace_id, state) as the ``budget`` - 1 most frequent ones and one for the rest, with the share that the rest holds."""
    return Op(f"""
WITH c AS (SELECT trace_id, state, count(*) AS n FROM {{states}} GROUP BY trace_id, state),
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, state) AS place, sum(n) OVER (PARTITION BY trace_id) AS total FROM c)
SELECT trace_id, CAST(least(place, {budget}) - 1 AS INT) AS label, sum(n) AS n, CASE WHEN min(place) >= {budget} THEN CAST(sum(n) AS DOUBLE) / max(total) ELSE 0 END AS lost FROM r GROUP BY trace_id, CAST(least(place, {budget}) - 1 AS INT)""")


def recurrent_sets(least: int = 2, top: int = 5) -> Op:
    """The most frequent sets of at least ``least`` kinds over owners; ties by the smallest owner that has it."""
    return Op(f"""
WITH s AS (SELECT owner, JOINED(SETOF(kind), ',') AS kinds, count(DISTINCT kind) AS n FROM {{members}} GROUP BY owner),
c AS (SELECT kinds, count(*) AS times, min(owner) AS first_owner FROM s WHERE n >= {least} GROUP BY kinds)
SELECT kinds, times, first_owner, place FROM (SELECT *, row_number() OVER (ORDER BY times DESC, first_owner) AS place FROM c) AS p WHERE place <= {top}""")


#: Single variables and the strongest pairs as candidates, each set once with its best weight.
CANDIDATES = Op("""
WITH s AS (SELECT trace_id, i AS a, i AS b, max(w) AS w FROM {similarity} GROUP BY trace_id, i UNION ALL SELECT trace_id, i, j, w FROM {similarity}),
r AS (SELECT trace_id, a, b, max(w) AS w FROM s GROUP BY trace_id, a, b)
SELECT trace_id, a, b, w, row_number() OVER (PARTITION BY trace_id ORDER BY w DESC, a, b) AS place FROM r
""")

STRONG_EDGES = Op("SELECT trace_id, i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY w DESC, i, j) AS place FROM {similarity}) AS r WHERE place <= 3")

#: Pairs of owners that share items, with their Jaccard similarity; each pair once. Items are joined, so owners without shared items do not meet.
JACCARD = Op("""
WITH s AS (SELECT owner, item, count(*) OVER (PARTITION BY owner) AS n FROM (SELECT DISTINCT owner, item FROM {members}) AS d)
SELECT a.owner AS a, b.owner AS b, count(*) AS shared, CAST(count(*) AS DOUBLE) / (max(a.n) + max(b.n) - count(*)) AS jaccard FROM s AS a JOIN s AS b ON b.item = a.item AND b.owner > a.owner GROUP BY a.owner, b.owner
""")

#: Variables of a trace that a cluster does not have.
EXTERNAL = Op("""
SELECT k.trace_id, k.cluster, v.var FROM (SELECT DISTINCT trace_id, cluster FROM {labels}) AS k JOIN {labels} AS v ON v.trace_id = k.trace_id AND v.cluster <> k.cluster
""")
