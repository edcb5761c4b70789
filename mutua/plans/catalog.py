"""Importing this module registers every query."""

from __future__ import annotations

from mutua.operators import information as info
from mutua.operators import preprocess as prep
from mutua.plans.registry import put
from mutua.sources.views import add_view
from mutua.sqltext import Op



def _alias(name: str, of: str, op: Op, placeholder: str = "trace", cut: bool = False) -> None:
    """A view made by an operator on another view."""
    add_view(name, Op(op.text.replace("{" + placeholder + "}", "{" + of + "}")), of, cut=cut)


_alias("hour_bins", "hourly", prep.quantile_bins(4))
_alias("ship_bins", "shipped", prep.quantile_bins(4))
add_view("roles", Op("SELECT DISTINCT event_type AS var, CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type = 'error' THEN -1 ELSE 1 END AS agent, CASE WHEN event_type IN ('click', 'purchase') THEN 'action' ELSE 'sensor' END AS role FROM {events}"), "events")
add_view("hour_mask", Op("SELECT trace_id, t, sum(value) >= 1 AS active FROM {hourly} GROUP BY trace_id, t"), "hourly")
add_view("peeled", Op("SELECT trace_id, max(var) AS var FROM {hourly} GROUP BY trace_id"), "hourly")
add_view("user_samples", Op("SELECT trace_id, CAST(DAYNO(ts, 2024-01-01) * 24 + hour(ts) AS DOUBLE) AS clock, value FROM {users}"), "users")
add_view("hour_weights", Op("SELECT trace_id AS grp, var AS item, avg(value) AS w FROM {hourly} GROUP BY trace_id, var"), "hourly")
_alias("hour_mi", "hour_bins", info.lag_max_mi(3), "bins", cut=True)
add_view("hour_sim", Op("SELECT trace_id, i, j, mi AS w FROM {hour_mi}"), "hour_mi")
#: Now and later of two variables, given two others: for conditional information.
add_view(
    "triples",
    Op("""SELECT concat(a.trace_id, '|', a.var, '|', b.var, '|', c.var) AS keys, a.x AS x, b.x AS y, c.x AS z FROM {binary} AS a JOIN {binary} AS b ON b.trace_id = a.trace_id AND b.t = a.t AND b.var > a.var JOIN {binary} AS c ON c.trace_id = a.trace_id AND c.t = a.t AND c.var <> a.var AND c.var <> b.var"""),
    "binary",
)
add_view(
    "runs",
    Op("SELECT a.var AS src, b.var AS dst, concat(a.trace_id, '|', CAST(DIV(a.t, 3) AS STRING)) AS run, CAST(a.t % 3 AS INT) AS step, a.x AS x, b.x AS y FROM {binary} AS a JOIN {binary} AS b ON b.trace_id = a.trace_id AND b.t = a.t AND b.var <> a.var"),
    "binary",
)

put("active_variables", prep.ACTIVE, "variance", trace="hourly")
put("trace_statistics", prep.TRACE_STATISTICS, "least_variance most_variance", "n_vars n_active", trace="hourly")
put("quantile_bins", prep.quantile_bins(4), trace="hourly")
put("equal_width_bins", prep.EQUAL_WIDTH_BINS, trace="shipped")
put("zscore", prep.ZSCORE, "z", trace="hourly")
put("first_difference", prep.FIRST_DIFFERENCE, "value", trace="hourly")
put("whitened", prep.PREPROCESS, "w", trace="hourly")
put("resample_uniform", prep.RESAMPLE_UNIFORM, "clock value", samples="user_samples")
put("lag1_autocorrelation", prep.LAG1_AUTOCORRELATION, "whole halves paired", trace="hourly")
put("edge_shift", prep.edge_shift(2), trace="hourly")
put("edge_shift_back", prep.edge_shift(-3), trace="hourly")
put("active_rows", prep.ACTIVE_ROWS, trace="hourly", mask="hour_mask")
put("peel_mask", prep.PEEL_MASK, trace="hourly", peeled="peeled")
put("threat_mask", prep.threat_mask(), trace="hourly")
put("window_samples", prep.window_samples(), "window_mean now previous later", trace="hourly")
put("prefix_window", prep.prefix_window(100), trace="hourly", variables="roles")
put("above_or_top", prep.above_or_top(0.5, 2), "w", weights="hour_weights")

put("lagged_mi", info.lagged_mi(3), "mi", bins="hour_bins")
put("lag_max_mi", info.lag_max_mi(3), "mi", bins="hour_bins")
put("lag_max_mi_shipped", info.lag_max_mi(3), "mi", bins="ship_bins")
put("similarity_distance", info.SIMILARITY_DISTANCE, "w distance", similarity="hour_sim")
put("sync_mi", info.SYNC_MI, "w", bins="hour_bins")
put("smoothed_cmi", info.smoothed_cmi(), "cmi", "n", observed="triples")
put("smoothed_cmi_bits", info.smoothed_cmi_bits(), "cmi_bits", "n", observed="triples")
put("plugin_bits", info.PLUGIN_BITS, "cmi_bits mi_bits entropy_x_bits", observed="triples")
put("plugin_cmi", info.PLUGIN_CMI, "cmi_bits", observed="triples")
put("entropy", info.ENTROPY, "bits nats", bins="hour_bins")
put("binary_entropy", info.BINARY_ENTROPY, "p nats", binary="binary")
put("joint_labels", info.JOINT_LABELS, ints="label", binary="binary")
put("transfer_entropy", info.transfer_entropy(), "te", binary="binary")
put("directed_information", info.directed_information(3), "directed", runs="runs")
put("lagged_correlation", info.LAGGED_CORRELATION, "w", trace="hourly")
put("cross_correlation", info.CROSS_CORRELATION, "r", trace="hourly")
put("scalar_gaussian_cmi", info.SCALAR_GAUSSIAN_CMI, "cmi", trace="hourly")
put("role_lag_matrix", info.ROLE_LAG_MATRIX, "r", trace="hourly", variables="roles")
put("change_rate", info.CHANGE_RATE, "rate", binary="binary")
put("mechanism_agreement", info.mechanism_agreement(), "disagreement predicted", binary="binary")

# ---- groups of variables, roles and boundaries
from mutua.operators import directed, grouping, overlaps, roles  # noqa: E402

add_view("clusters", Op("SELECT trace_id, var, CAST(dense_rank() OVER (PARTITION BY trace_id ORDER BY var) % 2 AS INT) AS cluster FROM (SELECT DISTINCT trace_id, var FROM {hourly}) AS v"), "hourly")
add_view("cuts", Op("SELECT trace_id, k, var, CAST(place % k AS INT) AS cluster FROM (SELECT trace_id, var, place, SEQ(1, 4) AS k FROM (SELECT trace_id, var, CAST(dense_rank() OVER (PARTITION BY trace_id ORDER BY var) AS INT) AS place FROM (SELECT DISTINCT trace_id, var FROM {hourly}) AS v) AS d) AS e"), "hourly")
add_view("cluster_series", Op(grouping.CLUSTER_SERIES.text.replace("{trace}", "{hourly}").replace("{labels}", "{clusters}")), "hourly", "clusters")
_alias("series_bins", "cluster_series", prep.quantile_bins(4))
_alias("series_auto", "cluster_series", prep.LAG1_AUTOCORRELATION)
_alias("series_mi", "series_bins", info.lag_max_mi(3), "bins", cut=True)
_alias("series_entropy", "series_bins", info.ENTROPY, "bins")
add_view("precursors", Op(grouping.precursor_stats().text.replace("{autocorrelation}", "{series_auto}").replace("{information}", "{series_mi}").replace("{entropy}", "{series_entropy}").replace("{labels}", "{clusters}")), "series_auto", "series_mi", "series_entropy", "clusters")
add_view("chunks", Op("SELECT trace_id, k AS chunk, var FROM {cuts} WHERE cluster = 0"), "cuts")
add_view("bought", Op("SELECT DISTINCT o_custkey AS owner, l_partkey AS item FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"), "orders", "lineitem")
add_view("supplied", Op("SELECT DISTINCT l_suppkey AS owner, l_partkey AS item FROM {lineitem}"), "lineitem")
add_view("user_types", Op("SELECT DISTINCT concat(CAST(user_id AS STRING), '|', CAST(HOURNO(ts) AS STRING)) AS owner, event_type AS kind FROM {events}"), "events")
_alias("joint_states", "binary", info.JOINT_LABELS, "binary")
add_view("binary_bins", Op("SELECT trace_id, t, var, x AS bin FROM {binary}"), "binary")
add_view("role_table", Op(roles.classify_roles().text.replace("{bins}", "{hour_bins}").replace("{labels}", "{clusters}")), "hour_bins", "clusters", cut=True)
add_view("blanket", Op(roles.blanket_test().text.replace("{states}", "{binary_bins}").replace("{roles}", "{role_table}")), "binary_bins", "role_table", cut=True)

_alias("signatures", "role_table", roles.ROLE_SIGNATURE, "roles")
add_view("role_penalties", Op("SELECT concat(trace_id, '|', CAST(cluster AS STRING)) AS trace_id, penalty FROM {signatures}"), "signatures")
add_view("no_penalties", Op("SELECT trace_id, penalty FROM {role_penalties} WHERE false"), "role_penalties")

put("weak_members", grouping.weak_members(), "mean_w cluster_mean", similarity="hour_sim", labels="clusters")
put("mdl_score", grouping.mdl_score(), "within score", "k", cuts="cuts", similarity="hour_sim")
put("cluster_series", grouping.CLUSTER_SERIES, "value", trace="hourly", labels="clusters")
put("precursor_stats", grouping.precursor_stats(), "persistence contingency richness", "size", autocorrelation="series_auto", information="series_mi", entropy="series_entropy", labels="clusters")
put("cluster_rank", grouping.cluster_rank(), "score", "place", labels="clusters", similarity="hour_sim", stats="precursors", penalties="role_penalties")
put("cluster_rank_by_size", grouping.cluster_rank(by_size=True), "score", "place", labels="clusters", similarity="hour_sim", stats="precursors", penalties="no_penalties")
put("partition_score", grouping.PARTITION_SCORE, "pass_rate mean_signal score", "n", stats="precursors")
put("fusion_edges", grouping.fusion_edges(), "weight", "pairs a b", chunks="chunks", similarity="hour_sim")
put("purity_match", grouping.PURITY_MATCH, "recall extra", by=overlaps.purity_match, found="bought", known="supplied")
put("cluster_kind", grouping.CLUSTER_KIND, "", "size n_agent n_world", labels="clusters", variables="roles")
put("compress_block", grouping.compress_block(), "lost", "label n", states="joint_states")
put("recurrent_sets", grouping.recurrent_sets(), "", "times place", members="user_types")
put("candidates", grouping.CANDIDATES, "w", "place", similarity="hour_sim")
put("strong_edges", grouping.STRONG_EDGES, "w", similarity="hour_sim")
put("jaccard", grouping.JACCARD, "jaccard", "shared", by=overlaps.jaccard_pairs, members="bought")
put("external_variables", grouping.EXTERNAL, labels="clusters")
put("role_classification", roles.classify_roles(), "outside later", bins="hour_bins", labels="clusters")
put("blanket_test", roles.blanket_test(), "violation", states="binary_bins", roles="role_table")
put("role_signature", roles.ROLE_SIGNATURE, "penalty", "n_sensors n_actions n_internal", roles="role_table")
put("threshold_sweep", roles.THRESHOLD_SWEEP, "threshold pass_rate", "n", tests="blanket")
put("select_cluster", roles.SELECT_CLUSTER, "violation", tests="blanket")

# ---- directional scores
_alias("transfer", "binary", info.transfer_entropy(), "binary", cut=True)
add_view("flows", Op(directed.PAIRWISE_SCORES.text.replace("{variables}", "{roles}")), "transfer", "roles")
#: Floors from each variable turned by some ticks against the others, as often as the reference does it.
SHIFTS = 200
_alias("turned_transfer", "binary", info.turned_transfer(SHIFTS), "binary", cut=True)
add_view("candidate_table", directed.ROLE_CANDIDATES, "binary")
_alias("loop_observations", "binary", directed.LOOP_OBSERVATIONS, "binary")
_alias("loop_terms", "loop_observations", info.PLUGIN_CMI, "observed", cut=True)
add_view("later_bins", Op("SELECT trace_id, t, var, x AS bin FROM (SELECT *, lead(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS x1 FROM {binary}) AS n WHERE x1 IS NOT NULL"), "binary")
_alias("later_entropies", "later_bins", info.ENTROPY, "bins")
add_view("scored", Op(directed.PASSIVE_SCORE.text.replace("{terms}", "{loop_terms}").replace("{candidates}", "{candidate_table}").replace("{entropies}", "{later_entropies}")), "loop_terms", "candidate_table", "later_entropies", cut=True)
_alias("posterior", "scored", directed.posterior(), "scored", cut=True)
_alias("masses", "posterior", directed.ROLE_MASS, "posterior")
#: One trace has tried all handles of its best candidate, others only its action or nothing.
add_view("tried", Op("SELECT trace_id, 'a' AS role, a AS var FROM {posterior} WHERE place = 1 AND trace_id <> '0' UNION ALL SELECT trace_id, 's', s FROM {posterior} WHERE place = 1 AND trace_id IN ('2', '3') UNION ALL SELECT trace_id, 'g', g FROM {posterior} WHERE place = 1 AND trace_id = '3'"), "posterior")

put("pairwise_scores", directed.PAIRWISE_SCORES, "push_in out_sys out_env polarity total_flow", transfer="transfer", variables="roles")
put("fused_scores", directed.fused_scores(), "push_in push_out", binary="binary")
put("best_key_scores", directed.best_key_scores(), "plain best", binary="binary")
put("changes_within", directed.changes_within(), "rate rate_after_one", binary="binary")
put("role_candidates", directed.ROLE_CANDIDATES, binary="binary")
put("passive_score", directed.PASSIVE_SCORE, "sensor policy control blanket activity score", "place", terms="loop_terms", candidates="candidate_table", entropies="later_entropies")
put("posterior", directed.posterior(), "p", "place", scored="scored")
put("role_mass", directed.ROLE_MASS, "mass", posterior="posterior")
put("next_operation", directed.NEXT_OPERATION, "mass gain", posterior="posterior", masses="masses", tried="tried")

# ---- influence, nulls, segments and metrics
from mutua.operators import influence, metrics, segments  # noqa: E402

add_view("series", Op("SELECT trace_id, t, max(CASE WHEN var = 'click' THEN value END) AS action, max(CASE WHEN var = 'error' THEN value END) AS outcome, max(CASE WHEN var = 'view' THEN value END) AS control FROM {hourly} GROUP BY trace_id, t"), "hourly")
add_view("points", Op("SELECT trace_id AS grp, t AS k, action AS y, control AS x FROM {series}"), "series")
_alias("influences", "series", influence.partial_influence(), "series")
_alias("odds", "series", influence.ODDS_RATIO, "series")
_alias("odds_bounds", "series", influence.bootstrap_odds(), "series")
add_view("agent_activity", Op("SELECT trace_id, var AS agent, t, value FROM {hourly}"), "hourly")
add_view("error_scores", Op("SELECT trace_id % 7 AS grp, round(value) AS score, event_type = 'error' AS label FROM {users}"), "users")
add_view("steps", Op("SELECT trace_id AS grp, t AS k, event_type AS state FROM {users}"), "users")
#: Rounded, as the observed flow is, so that equal scores are equal whatever the order of their sums.
add_view("null_samples", Op("SELECT split_part(sample, ':', 1) AS trace_id, var, round(sum(te), 12) AS score FROM (SELECT split_part(pair, '|', 1) AS sample, split_part(pair, '|', 3) AS var, te FROM {turned_transfer}) AS p GROUP BY sample, var"), "turned_transfer", cut=True)
_alias("turned_both", "binary", info.turned_transfer(SHIFTS, both=True), "binary", cut=True)
#: What each turned variable takes in, sends to the system, and both with what it sends to the environment.
add_view(
    "turned_flows",
    Op("""SELECT trace_id, var, name, round(CASE WHEN name = 'push_in' THEN flow WHEN name = 'out_sys' THEN sys ELSE flow + sys + env END, 12) AS score FROM (
  SELECT trace_id, var, sample, sum(CASE WHEN dst = var THEN te ELSE 0 END) AS flow, sum(CASE WHEN src = var AND agent >= 0 THEN te ELSE 0 END) AS sys, sum(CASE WHEN src = var AND agent < 0 THEN te ELSE 0 END) AS env
  FROM (SELECT split_part(split_part(pair, '|', 1), ':', 1) AS trace_id, split_part(pair, '|', 1) AS sample, split_part(pair, '|', 2) AS src, split_part(pair, '|', 3) AS dst, split_part(pair, '|', 4) AS var, te FROM {turned_both}) AS p
  JOIN (SELECT var AS target, agent FROM {roles}) AS r ON r.target = p.dst GROUP BY trace_id, var, sample) AS s
  JOIN (SELECT 'push_in' AS name UNION ALL SELECT 'out_sys' UNION ALL SELECT 'total_flow') AS k ON true"""),
    "turned_both", "roles", cut=True,
)
add_view("floors", Op("SELECT trace_id, var, name, PCT(score, 0.95) AS p95, avg(score) AS mean, stddev_pop(score) AS sd FROM {turned_flows} GROUP BY trace_id, var, name"), "turned_flows")
add_view("observed_flow", Op("SELECT trace_id, var, round(push_in, 12) AS score FROM {flows}"), "flows", cut=True)
add_view("busy", Op("SELECT trace_id, t, sum(value) >= 2 AS active FROM {hourly} GROUP BY trace_id, t"), "hourly")
add_view("activity", Op("SELECT trace_id, t, sum(value) AS value FROM {hourly} GROUP BY trace_id, t"), "hourly")
add_view("agents", Op("SELECT DISTINCT agent, t FROM {hourly} JOIN {roles} USING (var) WHERE agent >= 0"), "hourly", "roles")
_alias("segment_table", "busy", segments.active_runs(), "mask")
add_view("vector_labels", Op("SELECT 'all' AS grp, CASE WHEN ELEMENT(embedding, 1) > 0 THEN 1 ELSE 0 END + CASE WHEN ELEMENT(embedding, 2) > 0 THEN 2 ELSE 0 END AS a, label AS b FROM {embeddings}"), "embeddings")
add_view("ranked_events", Op("SELECT trace_id AS grp, event_id AS item, value AS score, event_type = 'purchase' AS relevant FROM {users}"), "users")
add_view("order_scores", Op("SELECT o_orderpriority AS grp, o_totalprice AS score FROM {orders}"), "orders")
add_view("curve", Op("SELECT l_returnflag AS grp, CAST(l_quantity AS BIGINT) AS size, avg(l_discount) AS metric FROM {lineitem} GROUP BY l_returnflag, CAST(l_quantity AS BIGINT)"), "lineitem")
add_view("flow_tests", Op("SELECT var AS grp, p, z FROM {flow_p}"), "flow_p")
add_view("flow_p", Op(influence.NULL_P_VALUE.text.replace("{observed}", "{observed_flow}").replace("{samples}", "{null_samples}")), "observed_flow", "null_samples")
add_view("cube_rows", Op("SELECT l_returnflag AS a, l_linestatus AS b, l_quantity AS v FROM {lineitem}"), "lineitem")
add_view("records", Op("SELECT user_id AS id, event_id AS arrival, event_type AS payload FROM {events}"), "events")
add_view("flags", Op(directed.signature_flags().text.replace("{scores}", "{flows}")), "flows", "floors")

put("residuals", influence.RESIDUALS, "residual", points="points")
put("partial_influence", influence.partial_influence(), "influence", "n", series="series")
put("odds_ratio", influence.ODDS_RATIO, "odds selectivity", series="series")
put("bootstrap_odds", influence.bootstrap_odds(), "low middle", "n", series="series")
put("influence_flag", influence.INFLUENCE_FLAG, "influence odds low selectivity combined", influence="influences", odds="odds", bootstrap="odds_bounds")
put("regulation", influence.REGULATION, "flatness ratio compensation regulation", series="series")
put("auroc", influence.AUROC, "auroc", scored="error_scores")
put("circular_shift", influence.circular_shift(), "", "perm t", trace="hourly")
put("scramble", influence.scramble(), "", "t", trace="hourly")
put("transition_matrix", influence.TRANSITION_MATRIX, "p", "n", steps="steps")
put("null_floors", influence.NULL_FLOORS, "p95 p995 mean sd", "n", samples="null_samples")
put("pooled_floors", influence.POOLED_FLOORS, "p95 p995 mean sd", "n", samples="null_samples")
put("null_p_value", influence.NULL_P_VALUE, "p z", observed="observed_flow", samples="null_samples")
put("signature_flags", directed.signature_flags(), "net_in net_out", scores="flows", floors="floors")
put("signature_flags_with_margin", directed.signature_flags(least_z=2.0), "net_in net_out", scores="flows", floors="floors")
put("scramble_verdict", directed.SCRAMBLE_VERDICT, "bound", "n n_drives", flags="flags")
put("active_runs", segments.active_runs(), "", "n", mask="busy")
put("sliding_segments", segments.sliding_segments(120, 60), mask="busy")
put("segment_parameters", segments.SEGMENT_PARAMETERS, "coefficient", activity="activity")
put("should_segment", segments.should_segment(), "least_share middle_share", activity="agent_activity")
put("episode_mask", segments.episode_mask(), agents="agents")
put("window_majority", segments.window_majority(), binary="binary")
put("winner_persistence", segments.WINNER_PERSISTENCE, "stays", "n", trace="hourly")
put("rank_within", segments.rank_within(), "value", "place", trace="hourly")
put("sessions", segments.sessions(), "total", "session n first_hour last_hour", users="users")
put("segment_totals", segments.range_join(), "total most", "n", segments="segment_table", trace="hourly")
put("as_of_error", segments.AS_OF, "value last_error_value", "t last_error_t", users="users")
put("adjusted_rand", metrics.ADJUSTED_RAND, "ari", labelled="vector_labels")
put("best_jaccard", metrics.BEST_JACCARD, "mean_jaccard recall", labelled="vector_labels")
put("cluster_purity", metrics.CLUSTER_PURITY, "purity label_entropy", "size", labelled="vector_labels")
put("recall_at_k", metrics.recall_at(), "recall prec", "first_place", ranked="ranked_events")
put("fisher_pool", metrics.FISHER_POOL, "mean_p pass_rate median_z combined_p", "n", tests="flow_tests")
put("leave_one_out", metrics.LEAVE_ONE_OUT, "own others gap", scores="order_scores")
put("summary", metrics.SUMMARY, "mean sd middle", "n", scores="order_scores")
put("breaking_point", metrics.breaking_point(0.05), "most", "breaks_at", curve="curve")
put("verdicts", metrics.VERDICTS, scores="order_scores")
put("cube", metrics.CUBE, "total", "n", rows="cube_rows")
put("first_record", metrics.FIRST_RECORD, records="records")
put("json_field", metrics.JSON_FIELD, "", "k missing", events="events")
put("validate_trace", metrics.VALIDATE, "", "n repeats n_null n_odd", trace="hourly")
put("dot_lines", metrics.DOT_LINES, similarity="hour_sim")
put("widen", metrics.widen(["click", "view", "error"]), trace="hourly")
put("pad_aligned", metrics.PAD_ALIGNED, "value", "t", trace="hourly")

# ---- small relational operators
from mutua.operators import relational  # noqa: E402

add_view("alias_names", Op("SELECT DISTINCT event_type AS var FROM {events} WHERE event_type LIKE '%p'"), "events")
add_view("agent_list", Op("SELECT trace_id, var, row_number() OVER (PARTITION BY trace_id ORDER BY var) AS place FROM (SELECT DISTINCT trace_id, var FROM {hourly}) AS v JOIN {roles} USING (var) WHERE role = 'sensor'"), "hourly", "roles")
add_view("world_list", Op("SELECT trace_id, var, row_number() OVER (PARTITION BY trace_id ORDER BY var DESC) AS place FROM (SELECT DISTINCT trace_id, var FROM {hourly}) AS v JOIN {roles} USING (var) WHERE agent <= 0"), "hourly", "roles")
add_view("operations", Op("SELECT trace_id, t, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS op, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS handle FROM {users}"), "users")
add_view("guesses", Op("SELECT trace_id AS grp, event_id AS item, value AS score FROM {users}"), "users")
add_view("facts", Op("SELECT user_id AS grp, event_id AS item, event_type = 'error' AS label FROM {events} WHERE event_type IN ('error', 'view')"), "events")
add_view("order_counts", Op("SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey"), "orders")
add_view("supplier_counts", Op("SELECT l_suppkey AS k, count(*) AS n FROM {lineitem} GROUP BY l_suppkey"), "lineitem")
add_view("communities", Op("SELECT l_orderkey AS community, concat(l_returnflag, l_linestatus, CAST(l_linenumber AS STRING)) AS class FROM {lineitem}"), "lineitem")
add_view("known_sets", Op("SELECT l_suppkey AS grp, l_partkey AS item FROM {lineitem}"), "lineitem")
add_view("admitted_sets", Op("SELECT l_suppkey AS grp, l_partkey AS item FROM {lineitem} WHERE l_discount > 5e-2"), "lineitem")
add_view("trials", Op("SELECT l_suppkey AS seed, l_linenumber AS slots, l_orderkey AS place, l_quantity AS score FROM {lineitem}"), "lineitem")
add_view("rounds", Op("SELECT l_returnflag AS grp, l_linenumber AS round, l_orderkey AS place, l_extendedprice AS value FROM {lineitem}"), "lineitem")
add_view("agent_records", Op("SELECT o_orderkey AS agent, o_orderstatus = 'F' AS admitted, o_totalprice / 400000 AS proposal, o_totalprice / 800000 AS trained, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 = 1 END AS agency_passed, o_orderkey % 7 = 0 AS peeled, o_orderkey % 5 = 0 AS gate_blocked FROM {orders}"), "orders")
add_view("method_rows", Op("SELECT l_returnflag AS kind, CAST(l_quantity AS INT) AS width, l_linestatus AS method, avg(l_discount) AS ari, CASE WHEN l_linestatus = 'O' THEN avg(l_tax) END AS own FROM {lineitem} GROUP BY l_returnflag, CAST(l_quantity AS INT), l_linestatus"), "lineitem")
add_view("references", Op("SELECT l_returnflag AS kind, CAST(l_quantity AS INT) AS width, max(l_discount) AS ari FROM {lineitem} WHERE l_quantity > 25 GROUP BY l_returnflag, CAST(l_quantity AS INT)"), "lineitem")
add_view("family_rows", Op("SELECT o_orderpriority AS family, o_totalprice > 150000 AS flagged, o_orderstatus = 'O' AS expected FROM {orders}"), "orders")
add_view("page_texts", Op("SELECT page_id AS id, html AS text FROM {pages}"), "pages")
add_view("true_loops", Op("SELECT trace_id, b, s, a, g, e FROM {candidate_table} WHERE b = 'click' AND s = 'error' AND a = 'purchase' AND g = 'signup' AND e = 'view'"), "candidate_table")
add_view("next_rows", Op("SELECT concat(s.trace_id, '|', s.var, '|', d.var) AS keys, row_number() OVER (PARTITION BY s.trace_id, s.var, d.var ORDER BY s.t) - 1 AS k, d.x1 AS x, s.x AS y, d.x AS z FROM {binary} AS s JOIN (SELECT *, lead(x) OVER (PARTITION BY trace_id, var ORDER BY t) AS x1 FROM {binary}) AS d ON d.trace_id = s.trace_id AND d.t = s.t AND d.var <> s.var WHERE d.x1 IS NOT NULL"), "binary", cut=True)

put("drop_aliases", relational.DROP_ALIASES, "value", trace="hourly", aliases="alias_names")
put("append", relational.APPEND, "value", first="hourly", second="shipped")
put("controls", relational.CONTROLS, ints="place", first="agent_list", second="world_list")
put("operation_mask", relational.operation_mask("click", "high", or_none=True), transitions="operations")
put("with_truth", relational.WITH_TRUTH, "score", predictions="guesses", truth="facts")
put("full_outer", relational.FULL_OUTER, ints="n_left n_right", left="order_counts", right="supplier_counts")
put("class_sets", relational.class_sets(), members="communities")
put("admitted_recall", relational.ADMITTED_RECALL, "recall", "admitted known", known="known_sets", admitted="admitted_sets")
put("best_of_group", relational.BEST_OF_GROUP, "score", rows="trials")
put("round_summary", relational.ROUND_SUMMARY, "mean middle", "n", rows="rounds")
put("miss_reason", relational.miss_reason(), agents="agent_records")
put("reference_gap", relational.REFERENCE_GAP, "reference gap", rows="method_rows", reference="references")
put("family_rates", relational.FAMILY_RATES, "flagged_rate accuracy", "n", rows="family_rows")
put("checksum", relational.CHECKSUM, texts="page_texts")
put("soft_zscore", relational.SOFT_ZSCORE, "z", trace="hourly")
put("truncate_aligned", relational.TRUNCATE_ALIGNED, "value", "agent t", trace="shipped")
put("rank_of_truth", relational.RANK_OF_TRUTH, "left_behind", "place n", scored="scored", truth="true_loops")
put("conservation", relational.conservation(3), "total forward backward residual", runs="runs")
put("bootstrap_cmi", relational.bootstrap_cmi(), "mean sd low high", "n", observed="next_rows")

# ---- dense operators: grouped pandas functions, checked in tests
from mutua.operators import dense, detector, graph, independence  # noqa: E402
from mutua.plans.registry import register  # noqa: E402
from mutua.sources.views import view  # noqa: E402


@register("cluster_variables")
def _cluster_variables(spark, sf_dir):
    return dense.cluster_variables(info.SIMILARITY_DISTANCE(similarity=view(spark, sf_dir, "hour_sim")))


@register("gaussian_block_information")
def _gaussian_block_information(spark, sf_dir):
    return dense.block_information(dense.moments(view(spark, sf_dir, "hourly")))


@register("principal_components")
def _principal_components(spark, sf_dir):
    return dense.principal_components(dense.moments(view(spark, sf_dir, "hourly")))


@register("match_clusters")
def _match_clusters(spark, sf_dir):
    return dense.match_clusters(view(spark, sf_dir, "vector_labels").groupBy("grp", "a", "b").count().withColumnRenamed("count", "n"))


@register("greedy_match")
def _greedy_match(spark, sf_dir):
    return relational.greedy_match(view(spark, sf_dir, "vector_labels").groupBy("grp", "a", "b").count().withColumnRenamed("count", "n"))


@register("null_of_synchrony")
def _null_of_synchrony(spark, sf_dir):
    def synchrony(trace):
        return info.SYNC_MI(bins=prep.quantile_bins(4)(trace=trace)).where("i < j").groupBy("trace_id").agg({"w": "sum"}).withColumnRenamed("sum(w)", "score")

    return relational.null_p_value(view(spark, sf_dir, "hourly"), synchrony, 100)


@register("phase_surrogate")
def _phase_surrogate(spark, sf_dir):
    return dense.phase_surrogate(view(spark, sf_dir, "hourly"))


@register("transition_surrogate")
def _transition_surrogate(spark, sf_dir):
    return dense.transition_surrogate(view(spark, sf_dir, "steps"))


@register("saturating_counters")
def _saturating_counters(spark, sf_dir):
    return dense.saturating_counters(view(spark, sf_dir, "binary"))


@register("components")
def _components(spark, sf_dir):
    """Customers and suppliers with a line item between them; as for all such jobs over whole tables there is no SQL, a test has brute force."""
    lines, orders = view(spark, sf_dir, "lineitem"), view(spark, sf_dir, "orders")
    edges = lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr("concat('customer ', o_custkey) AS src", "concat('supplier ', l_suppkey) AS dst").distinct()
    return graph.connected_components(edges)


@register("customer_part_components")
def _customer_part_components(spark, sf_dir):
    """Every customer and part with an order, as nodes of their own kind."""
    lines, orders = view(spark, sf_dir, "lineitem"), view(spark, sf_dir, "orders")
    edges = lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr("concat('customer ', o_custkey) AS src", "concat('part ', l_partkey) AS dst").distinct()
    return graph.connected_components(edges)


@register("detect")
def _detect(spark, sf_dir):
    return detector.detect(view(spark, sf_dir, "hourly"))


@register("choose_k")
def _choose_k(spark, sf_dir):
    return detector.choose_k(detector.detect(view(spark, sf_dir, "hourly")))


put("chi_square", independence.CHI_SQUARE, "chi2", "dof", observed="triples")


@register("conditional_independence")
def _conditional_independence(spark, sf_dir):
    return independence.conditional_independence(view(spark, sf_dir, "triples"))


@register("cross_validated_r2")
def _cross_validated_r2(spark, sf_dir):
    return independence.cross_validated_r2(view(spark, sf_dir, "series"), "outcome", ["action", "control"], "trace_id", "t")


@register("peel")
def _peel(spark, sf_dir):
    return detector.peel(view(spark, sf_dir, "hourly"), passes=2, tolerance=0.5)
