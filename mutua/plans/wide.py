"""Queries over wide traces: brands by day, parts by month. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from mutua.operators import background, members
from mutua.plans.registry import DIGITS, register
from mutua.sources.views import add_view, view, view_sql
from mutua.sqltext import Op

#: Daily quantities of every brand by return flag, filled with zeros.
add_view(
    "brands",
    Op("""
WITH e AS (SELECT l_returnflag AS trace_id, DAYNO(l_shipdate, 1992-01-01) AS t, p_brand AS var, l_quantity AS q FROM {lineitem} JOIN {part} ON p_partkey = l_partkey),
n AS (SELECT trace_id, t, var, sum(q) AS n FROM e GROUP BY trace_id, t, var),
span AS (SELECT trace_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY trace_id),
spine AS (SELECT trace_id, var, SEQ(lo, hi) AS t FROM (SELECT DISTINCT trace_id, var FROM e) AS v JOIN span USING (trace_id))
SELECT trace_id, CAST(t AS BIGINT) AS t, var, coalesce(n, CAST(0 AS DOUBLE)) AS value FROM spine LEFT JOIN n USING (trace_id, t, var)
"""),
    "lineitem", "part", cut=True,
)
#: Monthly quantities of every part, filled with zeros.
add_view(
    "parts",
    Op("""
WITH e AS (SELECT 'parts' AS trace_id, year(l_shipdate) * 12 + month(l_shipdate) AS t, concat('p', CAST(l_partkey AS STRING)) AS var, l_quantity AS q FROM {lineitem}),
n AS (SELECT trace_id, t, var, sum(q) AS n FROM e GROUP BY trace_id, t, var),
span AS (SELECT trace_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY trace_id),
spine AS (SELECT trace_id, var, SEQ(lo, hi) AS t FROM (SELECT DISTINCT trace_id, var FROM e) AS v JOIN span USING (trace_id))
SELECT trace_id, CAST(t AS BIGINT) AS t, var, coalesce(n, CAST(0 AS DOUBLE)) AS value FROM spine LEFT JOIN n USING (trace_id, t, var)
"""),
    "lineitem", cut=True,
)
#: Two series of every brand: what it ships a day and what that costs, in thousands and millions.
add_view(
    "brand_pairs",
    Op("""
WITH d AS (SELECT p_brand AS trace_id, CAST(DAYNO(l_shipdate, 1992-01-01) AS BIGINT) AS t, sum(l_quantity) / 1e3 AS quantity, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) / 1e6 AS price FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_brand, DAYNO(l_shipdate, 1992-01-01))
SELECT trace_id, t, 'quantity' AS var, CAST(quantity AS DOUBLE) AS value FROM d UNION ALL SELECT trace_id, t, 'price', CAST(price AS DOUBLE) FROM d
"""),
    "lineitem", "part", cut=True,
)
#: Sets of brands by the last part of their number, and their members' roles.
add_view("brand_sets", Op("SELECT DISTINCT trace_id, CAST(CAST(substr(var, 7) AS INT) % 5 AS STRING) AS set_id, var FROM {brands}"), "brands")
add_view("brand_roles", Op("SELECT DISTINCT trace_id, 'thirds' AS set_id, var, CASE CAST(substr(var, 7) AS INT) % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'interface' ELSE 'external' END AS role FROM {brands}"), "brands")
add_view("hour_roles", Op("SELECT DISTINCT trace_id, 'hours' AS set_id, var, CASE var WHEN 'click' THEN 'internal' WHEN 'view' THEN 'external' ELSE 'interface' END AS role FROM {hourly} WHERE var IN ('click', 'view', 'error')"), "hourly")


def _rounded(frame, *names):
    return frame.withColumns({c: F.round(c, DIGITS) + 0.0 for c in names})


#: Rank 1 of two series has the larger root of a quadratic for its variance, and one angle for its direction.
_RANK_ONE = """
WITH m AS (SELECT trace_id, var, avg(value) AS mean FROM b GROUP BY trace_id, var),
x AS (SELECT trace_id, t, max(CASE WHEN var = 'price' THEN value - mean END) AS p, max(CASE WHEN var = 'quantity' THEN value - mean END) AS q FROM b JOIN m USING (trace_id, var) GROUP BY trace_id, t),
g AS (SELECT trace_id, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, count(*) AS n FROM x GROUP BY trace_id),
e AS (SELECT *, (pp + qq) / 2 + sqrt(((pp - qq) / 2) * ((pp - qq) / 2) + pq * pq) AS root, atan2(2 * pq, pp - qq) / 2 AS turn FROM g),
r AS (SELECT trace_id, t, n, p, q, (p * cos(turn) + q * sin(turn)) AS score, cos(turn) AS vp, sin(turn) AS vq, CASE WHEN n > 1 THEN root / greatest(pp + qq, 1e-12) ELSE 0 END AS share FROM x JOIN e USING (trace_id))
SELECT trace_id, t, var, round(CASE WHEN n < 2 THEN CASE WHEN var = 'price' THEN p ELSE q END WHEN var = 'price' THEN p - score * vp ELSE q - score * vq END + mean, 6) + 0.0 AS value, round(share, 6) + 0.0 AS share FROM r JOIN m USING (trace_id)"""


@register("background_of_two", f"WITH b AS ({view_sql('brand_pairs')}) SELECT * FROM ({_RANK_ONE})")
def _background_of_two(spark, sf_dir):
    left = background.remove_background(view(spark, sf_dir, "brand_pairs"), 1)
    return left.withColumns({c: F.round(c, 6) + 0.0 for c in ("value", "share")})


@register("background_of_brands")
def _background_of_brands(spark, sf_dir):
    return background.remove_background(view(spark, sf_dir, "brands"), 2)


@register("background_of_parts")
def _background_of_parts(spark, sf_dir):
    """Every part by month. Months are few, so the component is exact; passes are for traces of many ticks."""
    return background.remove_background(view(spark, sf_dir, "parts"), 1, passes=4)


_LAGGED = """
WITH p AS (SELECT a.trace_id, a.var AS i, b.var AS j, a.value AS x, b.value AS y, la.value AS x1, lb.value AS y1 FROM h AS a JOIN h AS b ON b.trace_id = a.trace_id AND b.t = a.t
  JOIN h AS la ON la.trace_id = a.trace_id AND la.t = a.t + 1 AND la.var = a.var JOIN h AS lb ON lb.trace_id = b.trace_id AND lb.t = b.t + 1 AND lb.var = b.var)
SELECT trace_id, i, j, count(*) AS n, round(covar_pop(x, y), 9) + 0.0 AS past, round(covar_pop(x1, y1), 9) + 0.0 AS next, round(covar_pop(x, y1), 9) + 0.0 AS "cross" FROM p GROUP BY trace_id, i, j"""


@register("lagged_covariances", f"WITH h AS ({view_sql('hourly')}) SELECT * FROM ({_LAGGED})")
def _lagged_covariances(spark, sf_dir):
    return _rounded(members.lagged_covariances(members.lagged_moments(view(spark, sf_dir, "hourly"))), "past", "next", "cross")


_LOSS = """
WITH p AS (SELECT a.trace_id, a.value AS x, b.value AS y, c.value AS z FROM h AS a JOIN h AS b ON b.trace_id = a.trace_id AND b.t = a.t AND b.var = 'view' JOIN h AS c ON c.trace_id = a.trace_id AND c.t = a.t - 1 AND c.var = 'error' WHERE a.var = 'click'),
r AS (SELECT trace_id, 1 + 1e-6 AS d, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM p GROUP BY trace_id)
SELECT trace_id, 'hours' AS set_id, round(greatest(0, (ln(d * d - xz * xz) + ln(d * d - yz * yz) - ln(d) - ln(d * (d * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - d * xz))) / 2), 9) + 0.0 AS loss FROM r"""


@register("boundary_loss", f"WITH h AS ({view_sql('hourly')}) SELECT * FROM ({_LOSS})")
def _boundary_loss(spark, sf_dir):
    found = members.boundary_loss(members.lagged_moments(view(spark, sf_dir, "hourly")), view(spark, sf_dir, "hour_roles"))
    return _rounded(found.drop("draw"), "loss")


@register("boundary_of_brands")
def _boundary_of_brands(spark, sf_dir):
    return members.partition_null(members.lagged_moments(view(spark, sf_dir, "brands")), view(spark, sf_dir, "brand_roles"))


@register("member_scores")
def _member_scores(spark, sf_dir):
    return members.member_scores(members.lagged_moments(view(spark, sf_dir, "brands")), view(spark, sf_dir, "brand_sets")).drop("draw")


@register("member_null")
def _member_null(spark, sf_dir):
    return members.member_null(members.lagged_moments(view(spark, sf_dir, "brands")), view(spark, sf_dir, "brand_sets"))


@register("class_set_null")
def _class_set_null(spark, sf_dir):
    brands = view(spark, sf_dir, "brand_sets")
    classes = brands.select("trace_id", "var", F.col("var").alias("class"))
    return members.class_set_null(members.lagged_moments(view(spark, sf_dir, "brands")), classes, brands.select("set_id", F.col("var").alias("class")).distinct())


# ---- agents scored whole and by segments, and their regulation
from mutua.operators import scoring  # noqa: E402
from mutua.plans.registry import put  # noqa: E402

#: Five agents of five brands each, dealt by number: two sensors, two internal ones, one action.
add_view(
    "brand_agents",
    Op("""
SELECT var, agent, CAST(place AS INT) AS place, CASE WHEN place <= 2 THEN 'sensor' WHEN place <= 4 THEN 'internal' ELSE 'action' END AS role
FROM (SELECT var, agent, row_number() OVER (PARTITION BY agent ORDER BY number) AS place FROM (SELECT DISTINCT var, CAST(substr(var, 7) AS INT) AS number, CAST(substr(var, 7) AS INT) % 5 AS agent FROM {brands}) AS v) AS p
"""),
    "brands",
)
#: The days on which anything at all was shipped.
add_view("brand_days", Op("SELECT trace_id, t, sum(value) > 0 AS active FROM {brands} GROUP BY trace_id, t"), "brands")
_REGULATION = scoring.regulation_scores(ratio_max=2.0)
add_view("brand_regulation", Op(_REGULATION.text.replace("{trace}", "{brands}").replace("{roles}", "{brand_agents}").replace("{active}", "{brand_days}")), "brands", "brand_agents", "brand_days", cut=True)
put("regulation_scores", _REGULATION, "flatness ratio compensation regulation", trace="brands", roles="brand_agents", active="brand_days")
put("regulation_by_agent", scoring.regulation_by_agent(), "max_regulation", trace="brands", roles="brand_agents", scores="brand_regulation")


def _outcomes(spark):
    outcomes = spark.createDataFrame([("first", "Brand#1", "lower_is_better"), ("last", "Brand#25", "higher_is_better")], "name string, var string, direction string")
    return outcomes, spark.createDataFrame([("Brand#2",), ("Brand#3",)], "var string")


@register("segment_scores")
def _segment_scores(spark, sf_dir):
    """Every agent on two outcomes, by segments of every trace."""
    trace, roles = view(spark, sf_dir, "brands"), view(spark, sf_dir, "brand_agents")
    activity = scoring.agent_activity(trace, roles)
    series = scoring.agent_series(trace, roles, *_outcomes(spark), activity)
    return scoring.score_outcomes(series, activity, trace.select("trace_id").distinct())


@register("recording_scores")
def _recording_scores(spark, sf_dir):
    return scoring.score_recordings(view(spark, sf_dir, "brands"), view(spark, sf_dir, "brand_agents"), *_outcomes(spark))[1]


# ---- flows given grown keys, and scores against blocks
from mutua.operators import directed, keys  # noqa: E402

_ONE_KEY = directed.best_key_scores().duckdb(binary=view_sql("binary"))


@register("one_key_flows", f"SELECT trace_id, src, dst, round(plain, 9) + 0.0 AS plain, round(best, 9) + 0.0 AS best FROM ({_ONE_KEY})")
def _one_key_flows(spark, sf_dir):
    flows = keys.grown_flows(keys.variable_labels(view(spark, sf_dir, "binary")), depth=1)
    return _rounded(flows.select("trace_id", F.col("src.var").alias("src"), F.col("dst.var").alias("dst"), "plain", "best"), "plain", "best")


@register("grown_scores")
def _grown_scores(spark, sf_dir):
    binary = view(spark, sf_dir, "binary")
    return keys.grown_scores(keys.grown_flows(keys.variable_labels(binary)), directed.fused_scores()(binary=binary), "error")


@register("keyring_scores")
def _keyring_scores(spark, sf_dir):
    blocks = view(spark, sf_dir, "clusters").select("trace_id", "var", F.col("cluster").alias("block"))
    return keys.block_scores(view(spark, sf_dir, "binary"), blocks, "keyring", "error")


@register("menu_scores")
def _menu_scores(spark, sf_dir):
    blocks = view(spark, sf_dir, "clusters").select("trace_id", "var", F.col("cluster").alias("block"))
    return keys.block_scores(view(spark, sf_dir, "binary"), blocks, "menu", "error")


# ---- interventions: every fourth hour is undisturbed, the others' kinds and handles follow the hour
from mutua.operators import interventions  # noqa: E402
from mutua.operators.information import PLUGIN_CMI  # noqa: E402

add_view(
    "hour_operations",
    Op("""
WITH v AS (SELECT trace_id, var, row_number() OVER (PARTITION BY trace_id ORDER BY var) - 1 AS place, count(*) OVER (PARTITION BY trace_id) AS n FROM (SELECT DISTINCT trace_id, var FROM {binary}) AS d),
k AS (SELECT DISTINCT trace_id, t FROM {binary})
SELECT k.trace_id, k.t, CASE k.t % 4 WHEN 1 THEN 'sensor_flip' WHEN 2 THEN 'action_block' WHEN 3 THEN 'goal_flip' END AS op, CASE WHEN k.t % 4 > 0 THEN v.var END AS handle FROM k JOIN v ON v.trace_id = k.trace_id AND v.place = DIV(k.t, 4) % v.n
"""),
    "binary", cut=True,
)
add_view("test_observations", Op(interventions.OBSERVATIONS.text.replace("{operations}", "{hour_operations}").replace("{candidates}", "{candidate_table}")), "binary", "hour_operations", "candidate_table", cut=True)
add_view("test_terms", Op(PLUGIN_CMI.text.replace("{observed}", "{test_observations}")), "test_observations", cut=True)
put("interventional_score", interventions.INTERVENTIONAL_SCORE, "sensor_int action_int goal_int interventional", terms="test_terms", candidates="candidate_table")


@register("active_loop")
def _active_loop(spark, sf_dir):
    return interventions.active_loop(view(spark, sf_dir, "binary"), view(spark, sf_dir, "hour_operations"), view(spark, sf_dir, "scored"), rounds=3, batch=30)


# ---- communities by lagged affinity, cut at many thresholds
from mutua.operators import communities  # noqa: E402


def _cuts(spark, sf_dir):
    thresholds = spark.createDataFrame([(0.6,), (0.9,), (0.94,), (0.97,)], "threshold double")
    return communities.cut(communities.dendrogram(communities.lagged_affinity(members.lagged_moments(view(spark, sf_dir, "brands")))), thresholds)


@register("communities")
def _communities(spark, sf_dir):
    return communities.communities(_cuts(spark, sf_dir))


@register("community_coverage")
def _community_coverage(spark, sf_dir):
    return communities.coverage(_cuts(spark, sf_dir))


_AFFINITY = """
WITH p AS (SELECT a.trace_id, a.var AS i, b.var AS j, covar_pop(a.value, b.value) / ((stddev_pop(a.value) + 1e-12) * (stddev_pop(b.value) + 1e-12)) AS r FROM h AS a JOIN h AS b ON b.trace_id = a.trace_id AND b.t = a.t + 1 AND b.var <> a.var GROUP BY a.trace_id, a.var, b.var)
SELECT trace_id, least(i, j) AS i, greatest(i, j) AS j, round(max(abs(r)), 9) + 0.0 AS w FROM p GROUP BY trace_id, least(i, j), greatest(i, j)"""


@register("lagged_affinity", f"WITH h AS ({view_sql('brands')}) SELECT * FROM ({_AFFINITY})")
def _lagged_affinity(spark, sf_dir):
    return _rounded(communities.lagged_affinity(members.lagged_moments(view(spark, sf_dir, "brands"))), "w")
