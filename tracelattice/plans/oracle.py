"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from tracelattice.plans.queries import (
    CHAIN_LIMIT, DIMS, HIDDEN, MAX_HOPS, SEED, STEP_DECAY, STEP_RATE, STOP_WORDS, TOP_K, VOCABULARY, WIDE,
)

ORACLE: dict[str, str] = {}

# Common table expressions, each usable after the ones it names.
DAY_LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS group_id, ts, event_id,
    event_type AS event, epoch_us(ts) / 1e6 AS ts_s, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
    event_type || ' ' || props AS message, value, props
  FROM events)"""
USER_LOG = DAY_LOG.replace("CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR)", "CAST(user_id AS VARCHAR)")
MESSAGE_LOG = USER_LOG.replace("event_type AS event,", "event_type || ' ' || props AS event,")
LINE_LOG = """log AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS group_id, l_linenumber AS ts, (l_shipdate, l_partkey, l_suppkey) AS event_id,
    l_returnflag || l_linestatus AS event, epoch_us(l_shipdate) / 1e6 AS ts_s
  FROM lineitem)"""
TURN_LOG = """log AS (
  SELECT CAST(conv_id AS VARCHAR) AS group_id, turn AS ts, 0 AS event_id, role AS event, 0.0 AS ts_s FROM conversations)"""
STEPS = """steps AS (
  SELECT *, CASE WHEN next_event IS NOT NULL THEN greatest(0.0::DOUBLE, next_ts - ts_s) END AS dt FROM (
    SELECT *, row_number() OVER w - 1 AS pos, lead(event) OVER w AS next_event, lead(ts_s) OVER w AS next_ts,
      count(*) OVER (PARTITION BY group_id) AS total
    FROM log WINDOW w AS (PARTITION BY group_id ORDER BY ts, event_id)))"""
NODES = """nodes AS (
  SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY first_pos) - 1 AS INTEGER) AS node_id,
    event, n, first_pos, last_pos
  FROM (SELECT group_id, event, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM steps GROUP BY group_id, event))"""
PAIRS = """pairs AS (
  SELECT group_id, event AS src_event, next_event AS dst_event, dt FROM steps WHERE next_event IS NOT NULL)"""
LOOPED_PAIRS = """pairs AS (
  SELECT group_id, event AS src_event, coalesce(next_event, event) AS dst_event, coalesce(dt, 0.0) AS dt
  FROM steps WHERE next_event IS NOT NULL OR total = 1)"""
EDGES = """edges AS (
  SELECT e.group_id, s.node_id AS src, d.node_id AS dst, src_event, dst_event, e.n, mean_dt, var_dt
  FROM (SELECT group_id, src_event, dst_event, count(*) AS n, avg(dt) AS mean_dt, var_pop(dt) AS var_dt
        FROM pairs GROUP BY group_id, src_event, dst_event) e
  JOIN nodes s ON s.group_id = e.group_id AND s.event = src_event
  JOIN nodes d ON d.group_id = e.group_id AND d.event = dst_event)"""
GRAPHS = """graphs AS (
  SELECT n.group_id, n_events, n_nodes, coalesce(n_edges, 0) AS n_edges
  FROM (SELECT group_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_nodes FROM nodes GROUP BY group_id) n
  LEFT JOIN (SELECT group_id, count(*) AS n_edges FROM edges GROUP BY group_id) e USING (group_id))"""
LABELS = "labels_ AS (SELECT group_id, max(label) AS label FROM log GROUP BY group_id)"

LOOPED = ", ".join([DAY_LOG, STEPS, NODES, LOOPED_PAIRS, EDGES])
EDGE_COLUMNS = "group_id, src, dst, src_event, dst_event, n, round(mean_dt, 6) AS mean_dt, round(ln(1 + var_dt), 6) AS log_var_dt"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


for _name, _log, _pairs in (
    ("transition_edges", DAY_LOG, LOOPED_PAIRS),
    ("transition_edges_coarse", USER_LOG, PAIRS),
    ("transition_edges_lines", LINE_LOG, LOOPED_PAIRS),
    ("message_graph_edges", MESSAGE_LOG, LOOPED_PAIRS),
):
    ORACLE[_name] = f"{with_(_log, STEPS, NODES, _pairs, EDGES)} SELECT {EDGE_COLUMNS} FROM edges"
ORACLE["transition_counts_turns"] = (
    f"{with_(TURN_LOG, STEPS, NODES, PAIRS, EDGES)} SELECT group_id, src, dst, src_event, dst_event, n FROM edges"
)
ORACLE["working_projection"] = (
    f"{with_(DAY_LOG)} SELECT event_id AS \"LineId\", event AS \"EventId\", group_id AS \"GroupId\", "
    f"event AS \"EventTemplate\" FROM log"
)
ORACLE["graph_nodes"] = f"{with_(DAY_LOG, STEPS, NODES)} SELECT * FROM nodes"
ORACLE["consecutive_gaps"] = (
    f"{with_(DAY_LOG, STEPS)} SELECT group_id, event_id, pos, event, next_event, round(dt, 6) AS dt FROM steps"
)
ORACLE["graph_stats"] = (
    f"{with_(DAY_LOG, STEPS, NODES, PAIRS, EDGES, GRAPHS)} SELECT * FROM graphs WHERE n_edges >= 2"
)
ORACLE["graph_set_summary"] = f"""{with_(LOOPED, GRAPHS)}
SELECT count(*) AS n_graphs, round(avg(n_nodes), 6) AS mean_nodes, round(quantile_cont(n_nodes, 0.5), 6) AS median_nodes,
  round(avg(n_edges), 6) AS mean_edges, round(quantile_cont(n_edges, 0.5), 6) AS median_edges FROM graphs"""
ORACLE["collapsed_edges"] = f"""{with_(LOOPED)}
SELECT split_part(group_id, '_', 1) AS group_id, src_event AS src, dst_event AS dst, CAST(sum(n) AS DOUBLE) AS weight
FROM edges GROUP BY ALL"""
ORACLE["prefix_offsets"] = f"""{with_(LOOPED, GRAPHS)}
SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS graph_no,
  CAST(coalesce(sum(n_nodes) OVER (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS node_offset,
  n_nodes FROM graphs"""

# --- timing
GAPS = """gaps AS (
  SELECT group_id, coalesce(avg(lg), 0) AS gap_mean, coalesce(quantile_cont(lg, 0.5), 0) AS gap_median,
    coalesce(quantile_cont(lg, 0.95), 0) AS gap_p95, coalesce(stddev_pop(lg), 0) AS gap_std, coalesce(max(lg), 0) AS gap_max,
    coalesce(avg(zero), 0) AS zero_share
  FROM (SELECT group_id, ln(1 + dt) AS lg, CASE WHEN dt = 0 THEN 1.0 WHEN dt > 0 THEN 0.0 END AS zero FROM steps)
  GROUP BY group_id)"""
GAP_NAMES = ("gap_mean", "gap_median", "gap_p95", "gap_std", "gap_max", "zero_share")


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


ORACLE["gap_summary"] = f"{with_(DAY_LOG, STEPS, GAPS)} SELECT group_id, {rounded(*GAP_NAMES)} FROM gaps"
ORACLE["gap_summary_core"] = (
    f"{with_(USER_LOG, STEPS, GAPS)} SELECT group_id, {rounded('gap_mean', 'gap_median', 'gap_p95', 'gap_max')} FROM gaps"
)
ORACLE["edge_summary"] = f"""{with_(LOOPED)}
SELECT group_id, round(avg(m), 6) AS mean_log_mean_dt, round(avg(v), 6) AS mean_log_var_dt, round(max(m), 6) AS max_log_mean_dt,
  round(max(v), 6) AS max_log_var_dt, round(stddev_pop(m), 6) AS std_log_mean_dt, round(stddev_pop(v), 6) AS std_log_var_dt
FROM (SELECT group_id, ln(1 + mean_dt) AS m, ln(1 + var_dt) AS v FROM edges) GROUP BY group_id"""

# --- labels and splits
PLACES = f"""places AS (
  SELECT group_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || group_id), group_id) - 1 AS place
  FROM labels_)"""
SIZES = """classes AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM labels_),
normals AS (SELECT *, (n0 + n1) // 2 AS n, CAST(round_even(((n0 + n1) // 2) * (n0::DOUBLE / (n0 + n1)), 0) AS BIGINT) AS tn FROM classes),
sizes AS (SELECT *, n - tn AS ta, CAST(round_even(0.70::DOUBLE * tn, 0) AS BIGINT) AS tr,
  CAST(round_even(0.05::DOUBLE * tn, 0) AS BIGINT) AS va FROM normals)"""
CAPPED = """classes AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM labels_),
step1 AS (SELECT *, least(10000, n0 + n1) AS t FROM classes),
step2 AS (SELECT *, least(n1, CAST(round_even(t * n1::DOUBLE / (n0 + n1), 0) AS BIGINT)) AS a FROM step1),
step3 AS (SELECT *, least(n0, t - a) AS tn FROM step2),
sizes AS (SELECT *, least(n1, t - tn) AS ta, CAST(round_even(0.70::DOUBLE * tn, 0) AS BIGINT) AS tr,
  CAST(round_even(0.05::DOUBLE * tn, 0) AS BIGINT) AS va FROM step3)"""
ASSIGNED = """splits AS (
  SELECT group_id, label, CASE
    WHEN label = 0 AND place < tr THEN 'train' WHEN label = 0 AND place < tr + va THEN 'validation'
    WHEN label = 0 AND place < tn THEN 'test' WHEN label = 1 AND place < least(va, ta) THEN 'validation'
    WHEN label = 1 AND place < ta THEN 'test' END AS split
  FROM places, sizes)"""
PROTOCOL = ", ".join([LABELS, PLACES, SIZES, ASSIGNED])
COIN = """splits AS (
  SELECT group_id, label, CASE WHEN label = 0
    AND CAST(('0x' || substr(md5('1213:' || group_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.7::DOUBLE
    THEN 'train' ELSE 'test' END AS split FROM labels_)"""
ORACLE["group_labels"] = f"{with_(DAY_LOG, LABELS)} SELECT * FROM labels_"
ORACLE["named_labels"] = ORACLE["group_labels"]
ORACLE["stratified_sample"] = f"""{with_(DAY_LOG, LABELS, PLACES, SIZES)}
SELECT group_id, label FROM places, sizes
WHERE place < CASE WHEN label = 1 THEN trunc(n * 0.45::DOUBLE) ELSE trunc(n * (1 - 0.45::DOUBLE)) END"""
ORACLE["protocol_splits"] = f"{with_(DAY_LOG, PROTOCOL)} SELECT * FROM splits WHERE split IS NOT NULL"
ORACLE["protocol_splits_from_log"] = (
    f"{with_(DAY_LOG, LABELS, PLACES, CAPPED, ASSIGNED)} SELECT * FROM splits WHERE split IS NOT NULL"
)
ORACLE["bernoulli_split"] = f"{with_(DAY_LOG, LABELS, COIN)} SELECT * FROM splits"
ORACLE["held_out_groups"] = f"{with_(DAY_LOG, LABELS, COIN)} SELECT group_id, label FROM splits WHERE split = 'test'"
ORACLE["contaminated_splits"] = f"""{with_(DAY_LOG, LABELS, COIN)}
SELECT group_id, label, CASE WHEN label = 1
  AND row_number() OVER (PARTITION BY label, split ORDER BY md5('{SEED}:' || group_id), group_id) <= 40
  THEN 'train' ELSE split END AS split FROM splits"""
ORACLE["split_audit"] = f"""{with_(DAY_LOG, PROTOCOL)}
SELECT coalesce(split, 'total') AS split, count(*) AS n_graphs, count(*) FILTER (label = 0) AS normal,
  count(*) FILTER (label = 1) AS anomalous, round(count(*) FILTER (label = 1) / count(*)::DOUBLE, 6) AS anomaly_share
FROM splits WHERE split IS NOT NULL GROUP BY ROLLUP (split)"""
ORACLE["class_counts"] = f"""{with_(DAY_LOG, LABELS, COIN)}
SELECT split, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM splits GROUP BY split"""
ORACLE["split_leakage"] = f"""{with_(DAY_LOG, PROTOCOL)},
a AS (SELECT group_id FROM splits WHERE split = 'train'), b AS (SELECT group_id FROM splits WHERE split = 'validation'),
c AS (SELECT group_id FROM splits WHERE split = 'test')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS train_validation,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM c)) AS train_test,
  (SELECT count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM c)) AS validation_test"""
ORACLE["train_split_graphs"] = f"""{with_(LOOPED, GRAPHS, LABELS, COIN)}
SELECT graphs.* FROM graphs JOIN splits USING (group_id) WHERE split = 'train'"""
ORACLE["scaled_edges"] = f"""{with_(LOOPED, PROTOCOL)},
logs AS (SELECT group_id, src, dst, ln(1 + n) AS log_n, ln(1 + mean_dt) AS m, ln(1 + var_dt) AS v FROM edges),
fit AS (SELECT avg(m) AS mm, greatest(stddev_pop(m), 1e-6) AS ms, avg(v) AS vm, greatest(stddev_pop(v), 1e-6) AS vs
  FROM logs JOIN splits USING (group_id) WHERE split = 'train' AND label = 0)
SELECT group_id, src, dst, round(log_n, 6) AS log_n, round((m - mm) / ms, 6) AS log_mean_dt, round((v - vm) / vs, 6) AS log_var_dt
FROM logs, fit"""
_fits = ", ".join(f"avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-6) AS s_{c}" for c in GAP_NAMES)
_scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in GAP_NAMES)
ORACLE["scaled_gap_summary"] = f"""{with_(DAY_LOG, STEPS, GAPS, LABELS, COIN)},
fit AS (SELECT {_fits} FROM gaps JOIN splits USING (group_id) WHERE split = 'train' AND label = 0)
SELECT group_id, {_scaled} FROM gaps, fit"""
ORACLE["parsed_times"] = "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS ts_s FROM events"

# --- fields and node features
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")
BIN = "CAST(CAST(('0x' || substr(md5({c}), 1, 15)) AS BIGINT) % 32 AS INTEGER)"
NUMBERS = "list_transform(regexp_extract_all(props, '[0-9]+'), lambda x: CAST(x AS DOUBLE))"
PAIR_COMPONENT = "event_type || '::' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END"
ORACLE["parsed_fields"] = f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
  CASE WHEN event_type = 'error' THEN '0000100' ELSE '0010000' END AS onehot, event_type AS component,
  {BIN.format(c='event_type')} AS bin, CAST(len({NUMBERS}) AS INTEGER) AS n_params,
  round(sign(value - 10) * ln(1 + abs(value - 10)), 6) AS signed_log FROM events"""
ORACLE["message_severity"] = f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'UNKNOWN' END AS severity,
  event_type AS bracket_component, CASE WHEN event_type = 'error' THEN 'error' ELSE {PAIR_COMPONENT} END AS pair_component,
  CASE WHEN event_type = 'view' THEN event_type || ' ' || props ELSE event_type END AS named,
  trim(lower(regexp_replace(event_type || ' ' || props, '[^a-zA-Z\\s]', '', 'g'))) AS cleaned FROM events"""
ORACLE["param_stats"] = f"""{with_(DAY_LOG)}, v AS (SELECT group_id, event, unnest({NUMBERS}) AS v FROM log)
SELECT group_id, event, round(avg(v), 6) AS param_mean, round(stddev_pop(v), 6) AS param_std, min(v) AS param_min, max(v) AS param_max
FROM v GROUP BY group_id, event"""
POSITIONS = """positions AS (
  SELECT group_id, event, count(*)::DOUBLE / any_value(total) AS frequency, min(pos)::DOUBLE / any_value(total) AS first_rel,
    max(pos)::DOUBLE / any_value(total) AS last_rel FROM steps GROUP BY group_id, event)"""
ORACLE["node_positions"] = (
    f"{with_(DAY_LOG, STEPS, POSITIONS)} SELECT group_id, event, {rounded('frequency', 'first_rel', 'last_rel')} FROM positions"
)
ORACLE["node_modes"] = f"""{with_(USER_LOG)},
rows_ AS (SELECT group_id, event, CASE WHEN value > 50 THEN 'WARN' WHEN value > 20 THEN 'INFO' ELSE 'DEBUG' END AS severity,
  substr(props, 7, 1) AS component FROM log),
s AS (SELECT group_id, event, severity FROM (SELECT group_id, event, severity, count(*) AS n FROM rows_ GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY group_id, event ORDER BY n DESC, severity) = 1),
c AS (SELECT group_id, event, component FROM (SELECT group_id, event, component, count(*) AS n FROM rows_ GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY group_id, event ORDER BY n DESC, component) = 1)
SELECT group_id, event, severity, component FROM s JOIN c USING (group_id, event)"""
SIGNED = "sign({v}) * ln(1 + abs({v}))"
STATS = f"""params AS (
  SELECT group_id, event, avg(v) AS pm, stddev_pop(v) AS ps, min(v) AS pn, max(v) AS px
  FROM (SELECT group_id, event, unnest({NUMBERS}) AS v FROM log) GROUP BY group_id, event),
tail AS (
  SELECT group_id, event, [frequency, first_rel, last_rel, {", ".join(SIGNED.format(v=v) for v in ("pm", "ps", "pn", "px"))}] AS tail
  FROM positions JOIN params USING (group_id, event)),
stats AS (
  SELECT group_id, event, list_concat(
    list_transform({list(SEVERITIES)}, lambda s: CASE WHEN s = CASE WHEN event = 'error' THEN 'ERROR' ELSE 'INFO' END THEN 1.0::DOUBLE ELSE 0.0 END),
    list_transform(range(32), lambda i: CASE WHEN i = {BIN.format(c='event')} THEN 1.0::DOUBLE ELSE 0.0 END),
    tail) AS x
  FROM tail)"""


def micro(column: str, alias: str) -> str:
    return f"array_to_string(list_transform({column}, lambda v: CAST(CAST(round(v * 1e6, 0) AS BIGINT) AS VARCHAR)), ' ') AS {alias}"


def standardised(source: str) -> str:
    """Standardise list column x of a relation within its graph, dimension by dimension."""
    return f"""dims AS (SELECT group_id, event, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM {source}),
moments AS (SELECT group_id, d, count(*) AS n, avg(v) AS m, var_pop(v) AS s2 FROM dims GROUP BY group_id, d),
z AS (SELECT group_id, event, list(CASE WHEN n = 1 THEN v
    WHEN s2 <= n * 2.220446049250313e-16 * s2 + pow(n * m * 2.220446049250313e-16, 2) THEN 0.0
    ELSE (v - m) / sqrt(s2) END ORDER BY d) AS x
  FROM dims JOIN moments USING (group_id, d) GROUP BY group_id, event)"""


ORACLE["node_statistics"] = (
    f"{with_(DAY_LOG, STEPS, POSITIONS, STATS)} SELECT group_id, event, {micro('x', 'stats')} FROM stats"
)
ORACLE["standardised_nodes"] = f"""{with_(DAY_LOG, STEPS, POSITIONS, STATS)},
{standardised('stats')} SELECT group_id, event, {micro('x', 'x')} FROM z"""
VECTORS = """vectors AS (
  SELECT coalesce(['click', 'error', 'purchase', 'signup', 'view'][label + 1], 'label_' || label) AS event, list(v ORDER BY d) AS vec
  FROM (SELECT label, d, avg(v) AS v FROM (
    SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d)
  GROUP BY label)"""
ORACLE["node_features"] = f"""{with_(DAY_LOG, STEPS, POSITIONS, STATS, VECTORS)},
wide AS (SELECT group_id, event, list_concat(vec, x) AS x FROM stats JOIN vectors USING (event)),
{standardised('wide')} SELECT group_id, event, {micro('x', 'x')} FROM z"""
ORACLE["distinct_messages"] = f"{with_(DAY_LOG)} SELECT DISTINCT message AS text FROM log"
ORACLE["encoded_messages"] = f"""{with_(DAY_LOG)} SELECT DISTINCT message AS event, length(message)::DOUBLE AS n_chars,
  length(regexp_replace(message, '[^0-9]', '', 'g'))::DOUBLE AS n_digits FROM log"""
SPACE = r"\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
for _name, _limit in (("tfidf_terms", ""), ("tfidf_top_terms", f"ORDER BY sum(tf) DESC, term LIMIT {VOCABULARY}")):
    ORACLE[_name] = f"""WITH words AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '[^a-zA-Z{SPACE}]', '', 'g')), '[{SPACE}]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE length(term) >= 2 AND term NOT IN ({_stop}) GROUP BY doc_id, term),
vocabulary AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
  FROM counts GROUP BY term {_limit}),
weighted AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN vocabulary USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted"""

# --- adjacency
WEIGHTED = f"{LOOPED}, w AS (SELECT group_id, src, dst, n::DOUBLE AS w FROM edges)"


def looped(source: str, name: str) -> str:
    """Self-loops added and parallel edges summed."""
    return f"""{name} AS (SELECT group_id, src, dst, sum(w) AS w FROM (
  SELECT group_id, src, dst, w FROM {source} UNION ALL SELECT group_id, node_id, node_id, 1.0 FROM nodes) GROUP BY group_id, src, dst)"""


def row_stochastic(source: str, name: str) -> str:
    return f"""{name}_full AS (SELECT * FROM (WITH {looped(source, 'f')} SELECT * FROM f)),
{name} AS (SELECT group_id, src, dst, w / sum(w) OVER (PARTITION BY group_id, src) AS p FROM {name}_full)"""


def normalised(source: str, name: str) -> str:
    return f"""{name}_deg AS (SELECT group_id, src AS node_id, sum(w) AS deg FROM {source} GROUP BY group_id, src),
{name} AS (SELECT e.group_id, e.src, e.dst, e.w / sqrt(a.deg * b.deg) AS w FROM {source} e
  JOIN {name}_deg a ON a.group_id = e.group_id AND a.node_id = e.src
  JOIN {name}_deg b ON b.group_id = e.group_id AND b.node_id = e.dst)"""


UNDIRECTED = f"""both_ways AS (
  SELECT DISTINCT group_id, src, dst, 1.0::DOUBLE AS w FROM (SELECT group_id, src, dst FROM w UNION ALL SELECT group_id, dst, src FROM w)),
{looped('both_ways', 'und')}, {normalised('und', 'adj')}"""
RANKED = f"""{row_stochastic('w', 'p')}, sizes AS (SELECT group_id, count(*) AS size FROM nodes GROUP BY group_id),
rounds AS (
  SELECT group_id, node_id, 1.0::DOUBLE / size AS pi, 0 AS k FROM nodes JOIN sizes USING (group_id)
  UNION ALL
  SELECT p.group_id, p.dst, 0.9::DOUBLE * sum(p.p * r.pi) + 0.1::DOUBLE / any_value(s.size), r.k + 1
  FROM rounds r JOIN p ON p.group_id = r.group_id AND p.src = r.node_id JOIN sizes s ON s.group_id = p.group_id
  WHERE r.k < 300 GROUP BY p.group_id, p.dst, r.k),
pi AS (SELECT group_id, node_id, pi FROM rounds WHERE k = 300)"""


def balanced(source: str, name: str) -> str:
    return f"""{name}_half AS (SELECT q.group_id, q.src, q.dst, sqrt(a.pi / b.pi) * q.p AS w FROM {source} q
  JOIN pi a ON a.group_id = q.group_id AND a.node_id = q.src JOIN pi b ON b.group_id = q.group_id AND b.node_id = q.dst),
{name}_sym AS (SELECT group_id, src, dst, sum(w) / 2 AS w FROM (
  SELECT group_id, src, dst, w FROM {name}_half UNION ALL SELECT group_id, dst, src, w FROM {name}_half) GROUP BY group_id, src, dst),
{normalised(f'{name}_sym', name)}"""


RECURSIVE = "WITH RECURSIVE "
ADJ_COLUMNS = "group_id, src, dst, round(w, 6) AS w"
ORACLE["adj_undirected"] = f"{with_(WEIGHTED, UNDIRECTED)} SELECT {ADJ_COLUMNS} FROM adj"
ORACLE["adj_self_loops"] = f"""{with_(WEIGHTED)} SELECT {ADJ_COLUMNS} FROM w
UNION ALL SELECT group_id, node_id, node_id, 1.0 FROM nodes"""
ORACLE["transition_matrix"] = f"{with_(WEIGHTED, row_stochastic('w', 'p'))} SELECT group_id, src, dst, round(p, 6) AS p FROM p"
ORACLE["node_degrees"] = f"{with_(WEIGHTED)} SELECT group_id, src AS node_id, sum(w) AS deg FROM w GROUP BY group_id, src"
ORACLE["symmetric_edges"] = f"""{with_(WEIGHTED)} SELECT group_id, src, dst, sum(w) / 2 AS w FROM (
  SELECT group_id, src, dst, w FROM w UNION ALL SELECT group_id, dst, src, w FROM w) GROUP BY group_id, src, dst"""
ORACLE["pagerank"] = f"{RECURSIVE}{WEIGHTED}, {RANKED} SELECT group_id, node_id, round(round(pi, 10), 6) AS pi FROM pi"
ORACLE["adj_ppr"] = f"{RECURSIVE}{WEIGHTED}, {RANKED}, {balanced('p', 'adj')} SELECT {ADJ_COLUMNS} FROM adj"
ORACLE["adj_pr"] = f"""{RECURSIVE}{WEIGHTED}, {RANKED},
dense AS (SELECT a.group_id, a.node_id AS src, b.node_id AS dst, 0.9::DOUBLE * coalesce(p.p, 0) + 0.1::DOUBLE / size AS p
  FROM nodes a JOIN nodes b ON a.group_id = b.group_id JOIN sizes ON sizes.group_id = a.group_id
  LEFT JOIN p ON p.group_id = a.group_id AND p.src = a.node_id AND p.dst = b.node_id),
{balanced('dense', 'adj')} SELECT {ADJ_COLUMNS} FROM adj"""
ORACLE["pr_factors"] = f"""{RECURSIVE}{WEIGHTED}, {RANKED},
halves AS (SELECT p.group_id, src, dst, 0.45::DOUBLE * p.p * sqrt(a.pi) / sqrt(b.pi) AS w FROM p
  JOIN pi a ON a.group_id = p.group_id AND a.node_id = p.src JOIN pi b ON b.group_id = p.group_id AND b.node_id = p.dst),
sp AS (SELECT group_id, src, dst, sum(w) AS w FROM (SELECT * FROM halves UNION ALL SELECT group_id, dst, src, w FROM halves) GROUP BY ALL),
total AS (SELECT group_id, sum(sqrt(pi)) AS sa, sum(1 / sqrt(pi)) AS sb, 0.05::DOUBLE / count(*) AS c FROM pi GROUP BY group_id),
scale AS (SELECT pi.group_id, node_id, any_value(pi) AS pi, any_value(c) AS c,
    sqrt(sum(w) + any_value(c * (sqrt(pi) * sb + sa / sqrt(pi)))) AS s
  FROM pi JOIN total USING (group_id) JOIN sp ON sp.group_id = pi.group_id AND sp.src = node_id GROUP BY pi.group_id, node_id)
SELECT sp.group_id, src, dst, round(w / (x.s * y.s), 6) AS w, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c FROM sp
  JOIN scale x ON x.group_id = sp.group_id AND x.node_id = src JOIN scale y ON y.group_id = sp.group_id AND y.node_id = dst
UNION ALL SELECT group_id, node_id, NULL::INTEGER, NULL::DOUBLE, round(sqrt(pi) / s, 6), round(1 / sqrt(pi) / s, 6), round(c, 6) FROM scale"""
SECOND = f"""{row_stochastic('adj', 'p2')},
l_in AS (SELECT a.group_id, a.dst AS i, b.dst AS j, sum(a.p * b.p) AS v FROM p2 a JOIN p2 b ON a.group_id = b.group_id AND a.src = b.src GROUP BY ALL),
l_out AS (SELECT a.group_id, a.src AS i, b.src AS j, sum(a.p * b.p) AS v FROM p2 a JOIN p2 b ON a.group_id = b.group_id AND a.dst = b.dst GROUP BY ALL),
second_raw AS (SELECT group_id, i AS src, j AS dst, (l_in.v + l_out.v) / 2 AS w FROM l_in JOIN l_out USING (group_id, i, j)
  WHERE l_in.v <> 0 AND l_out.v <> 0),
{normalised('second_raw', 'second')}"""
ORACLE["adj_second_order"] = f"""{RECURSIVE}{WEIGHTED}, {RANKED}, {balanced('p', 'adj')}, {SECOND}
SELECT {ADJ_COLUMNS}, 1 AS ord FROM adj UNION ALL SELECT {ADJ_COLUMNS}, 2 AS ord FROM second"""

# --- message passing and scores
X = f"{VECTORS}, x AS (SELECT group_id, node_id, vec AS x FROM nodes JOIN vectors USING (event))"
XD = "xd AS (SELECT group_id, node_id, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM x)"
NODE_X = f"{LOOPED}, {X}, {XD}"
MOVED = """moved AS (SELECT a.group_id, a.dst AS node_id, d, sum(a.w * xd.v) AS v FROM adj a
  JOIN xd ON xd.group_id = a.group_id AND xd.node_id = a.src GROUP BY a.group_id, a.dst, d)"""
GRAPH_X = f"{WEIGHTED}, {UNDIRECTED}, {X}, {XD}"
ORACLE["propagate_once"] = f"""{with_(GRAPH_X, MOVED)}, packed AS (
  SELECT group_id, node_id, list(v ORDER BY d) AS x FROM moved GROUP BY group_id, node_id)
SELECT group_id, node_id, {micro('x', 'x')} FROM packed"""
for _name, _fn in (("mean_pool", "avg"), ("sum_pool", "sum"), ("max_pool", "max")):
    ORACLE[_name] = f"""{with_(NODE_X)}, z AS (SELECT group_id, list(v ORDER BY d) AS z FROM (
  SELECT group_id, d, {_fn}(v) AS v FROM xd GROUP BY group_id, d) GROUP BY group_id) SELECT group_id, {micro('z', 'z')} FROM z"""
ORACLE["edge_pool"] = f"""{with_(LOOPED)}, t AS (SELECT group_id, [avg(m), avg(v), max(m), max(v)] AS t FROM (
  SELECT group_id, ln(1 + mean_dt) AS m, ln(1 + var_dt) AS v FROM edges) GROUP BY group_id)
SELECT group_id, {micro('t', 't')} FROM t"""
DISTANCES = """zd AS (SELECT group_id, d, avg(v) AS v FROM xd GROUP BY group_id, d),
c AS (SELECT d, avg(v) AS c FROM zd JOIN splits USING (group_id) WHERE split = 'train' AND label = 0 GROUP BY d),
dist AS (SELECT group_id, sum((v - c) * (v - c)) AS sq FROM zd JOIN c USING (d) GROUP BY group_id)"""
ORACLE["centre_distance"] = f"""{with_(NODE_X, LABELS, COIN, DISTANCES)}
SELECT group_id, label, round(sqrt(sq), 6) AS score, round(sq, 6) AS score_sq FROM dist JOIN labels_ USING (group_id)"""
ORACLE["most_anomalous"] = f"""{with_(NODE_X, LABELS, COIN, DISTANCES)}
SELECT group_id, round(sqrt(sq), 6) AS score FROM dist ORDER BY score DESC, group_id LIMIT 10"""
ORACLE["node_importance"] = f"""{with_(NODE_X)}, zd AS (SELECT group_id, d, avg(v) AS m FROM xd GROUP BY group_id, d)
SELECT group_id, node_id, round(sqrt(sum((v - m) * (v - m))), 6) AS importance FROM xd JOIN zd USING (group_id, d) GROUP BY group_id, node_id"""
ORACLE["unit_vectors"] = f"""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS norm FROM n),
u AS (SELECT vec_id, list_transform(v, lambda a: a / norm) AS u FROM s) SELECT vec_id, {micro('u', 'u')} FROM u"""


def weights(rows: int, cols: int, name: str) -> str:
    """The formula weights as rows (d, h, wt), both 1-based."""
    return f"""{name} AS (SELECT i + 1 AS d, j + 1 AS h, ((7 * i + 3 * j) % 11 - 5) / 10.0::DOUBLE AS wt
  FROM range({rows}) a(i), range({cols}) b(j))"""


def columns(rows: int, cols: int, name: str) -> str:
    """The formula weights as one list per column h."""
    return f"""{name} AS (SELECT j + 1 AS h, list((((7 * i + 3 * j) % 11 - 5) / 10.0::DOUBLE) ORDER BY i) AS col
  FROM range({rows}) a(i), range({cols}) b(j) GROUP BY j)"""


MOVED_LISTS = "moved_l AS (SELECT group_id, node_id, list(v ORDER BY d) AS x FROM moved GROUP BY group_id, node_id)"
CONVOLVED = f"""{MOVED_LISTS}, {columns(DIMS, WIDE, 'c1')}, {columns(WIDE, WIDE, 'c2')},
hidden AS (SELECT group_id, node_id, h AS d, greatest(list_dot_product(x, col), 0.0::DOUBLE) AS v FROM moved_l, c1)"""
# Convolution, relu, convolution over every node, and then the mean of the nodes.
ORACLE["encode_two_layers"] = f"""{with_(GRAPH_X, MOVED, CONVOLVED)},
again AS (SELECT a.group_id, a.dst AS node_id, d, sum(a.w * hidden.v) AS v FROM adj a
  JOIN hidden ON hidden.group_id = a.group_id AND hidden.node_id = a.src GROUP BY a.group_id, a.dst, d),
again_l AS (SELECT group_id, node_id, list(v ORDER BY d) AS x FROM again GROUP BY group_id, node_id),
outputs AS (SELECT group_id, node_id, h, list_dot_product(x, col) AS v FROM again_l, c2),
z AS (SELECT group_id, list(v ORDER BY h) AS z FROM (SELECT group_id, h, avg(v) AS v FROM outputs GROUP BY group_id, h) GROUP BY group_id)
SELECT group_id, {micro('z', 'z')} FROM z"""
# Convolution, relu, mean of the nodes, linear map.
ORACLE["encode_one_layer"] = f"""{with_(GRAPH_X, MOVED, CONVOLVED)},
mean_l AS (SELECT group_id, list(v ORDER BY d) AS x FROM (SELECT group_id, d, avg(v) AS v FROM hidden GROUP BY group_id, d) GROUP BY group_id),
z AS (SELECT group_id, list(list_dot_product(x, col) ORDER BY h) AS z FROM mean_l, c2 GROUP BY group_id)
SELECT group_id, {micro('z', 'z')} FROM z"""
# The encoder by PageRank-normalised edges with formula weights, in long form: pre-activations, graph sums r, vectors z.
FORWARD = f"""{RANKED}, {balanced('p', 'adj')}, {X}, {XD}, {MOVED}, {weights(DIMS, HIDDEN, 'w1')}, {weights(HIDDEN, HIDDEN, 'w2')},
n_nodes AS (SELECT group_id, count(*) AS n FROM nodes GROUP BY group_id),
shares AS (SELECT group_id, src AS node_id, sum(w) / any_value(n) AS s FROM adj JOIN n_nodes USING (group_id) GROUP BY group_id, src),
pre AS (SELECT group_id, node_id, h, sum(v * wt) AS v FROM moved JOIN w1 USING (d) GROUP BY group_id, node_id, h),
r AS (SELECT group_id, h, sum(greatest(v, 0.0::DOUBLE) * s) AS v FROM pre JOIN shares USING (group_id, node_id) GROUP BY group_id, h),
z AS (SELECT group_id, w2.h, sum(v * wt) AS v FROM r JOIN w2 ON w2.d = r.h GROUP BY group_id, w2.h)"""
TRAINED = "trained AS (SELECT group_id FROM splits WHERE split = 'train' AND label = 0)"
CENTRED = "c AS (SELECT h, avg(v) AS c FROM {z} JOIN trained USING (group_id) GROUP BY h)"
SCORED = """SELECT group_id, label, round(score, 6) AS score FROM (
  SELECT group_id, sqrt(sum((v - c) * (v - c))) AS score FROM {z} JOIN c USING (h) GROUP BY group_id) JOIN labels_ USING (group_id)"""
ORACLE["one_class_step"] = f"""{RECURSIVE}{WEIGHTED}, {LABELS}, {COIN}, {TRAINED}, {FORWARD}, {CENTRED.format(z='z')},
gap AS (SELECT group_id, h, 2 * (v - c) AS g FROM z JOIN c USING (h) JOIN trained USING (group_id)),
many AS (SELECT count(*)::DOUBLE AS n FROM trained),
g2 AS (SELECT r.h AS d, gap.h, sum(r.v * g) / any_value(n) AS g FROM r JOIN gap USING (group_id), many GROUP BY r.h, gap.h),
gr AS (SELECT group_id, w2.d AS h, sum(g * wt) AS g FROM gap JOIN w2 USING (h) GROUP BY group_id, w2.d),
back AS (SELECT group_id, node_id, h, s * g AS g FROM pre JOIN shares USING (group_id, node_id) JOIN gr USING (group_id, h) WHERE v > 0),
g1 AS (SELECT d, h, sum(moved.v * back.g) / any_value(n) AS g FROM moved JOIN back USING (group_id, node_id), many GROUP BY d, h),
v1 AS (SELECT d, h, wt - {STEP_RATE} * (coalesce(g, 0) + {STEP_DECAY} * wt) AS wt FROM w1 LEFT JOIN g1 USING (d, h)),
v2 AS (SELECT d, h, wt - {STEP_RATE} * (coalesce(g, 0) + {STEP_DECAY} * wt) AS wt FROM w2 LEFT JOIN g2 USING (d, h)),
pre_b AS (SELECT group_id, node_id, h, sum(v * wt) AS v FROM moved JOIN v1 USING (d) GROUP BY group_id, node_id, h),
r_b AS (SELECT group_id, h, sum(greatest(v, 0.0::DOUBLE) * s) AS v FROM pre_b JOIN shares USING (group_id, node_id) GROUP BY group_id, h),
z_b AS (SELECT group_id, v2.h, sum(v * wt) AS v FROM r_b JOIN v2 ON v2.d = r_b.h GROUP BY group_id, v2.h)
{SCORED.format(z='z_b')}"""


def residual(source: str, keys: str, width: int, name: str) -> str:
    """tanh of the timing branch with formula weights over rows (keys, t list): name (keys, h, v)."""
    return f"""{columns(width, HIDDEN, name + '_u')}, {columns(HIDDEN, HIDDEN, name + '_v')},
{name}_h AS (SELECT {keys}, h, list_dot_product(t, col) AS v FROM {source}, {name}_u),
{name}_n AS (SELECT {keys}, h, greatest((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5::DOUBLE), 0.0::DOUBLE) AS v
  FROM {name}_h WINDOW w AS (PARTITION BY {keys})),
{name}_l AS (SELECT {keys}, list(v ORDER BY h) AS x FROM {name}_n GROUP BY {keys}),
{name} AS (SELECT {keys}, h, tanh(list_dot_product(x, col)) AS v FROM {name}_l, {name}_v)"""


_gap_list = ", ".join(f"({c} - m_{c}) / s_{c}" for c in GAP_NAMES)
ORACLE["fused_graph_scores"] = f"""{RECURSIVE}{WEIGHTED}, {GAPS}, {LABELS}, {COIN}, {TRAINED}, {FORWARD},
fit AS (SELECT {_fits} FROM gaps JOIN trained USING (group_id)),
timing AS (SELECT group_id, [{_gap_list}] AS t FROM gaps, fit), {residual('timing', 'group_id', len(GAP_NAMES), 'e')},
fused AS (SELECT group_id, h, z.v + 0.1::DOUBLE * e.v AS v FROM z JOIN e USING (group_id, h)), {CENTRED.format(z='fused')}
{SCORED.format(z='fused')}"""
# Two timed convolutions node by node, then the mean of the nodes.
ORACLE["timed_edge_scores"] = f"""{RECURSIVE}{WEIGHTED}, {LABELS}, {COIN}, {TRAINED}, {RANKED}, {balanced('p', 'adj')}, {X}, {XD}, {MOVED},
{weights(DIMS, HIDDEN, 'w1')}, {weights(HIDDEN, HIDDEN, 'w2')},
logs AS (SELECT group_id, src, dst, ln(1 + mean_dt) AS m, ln(1 + var_dt) AS v FROM edges),
fit AS (SELECT avg(m) AS mm, greatest(stddev_pop(m), 1e-6) AS ms, avg(v) AS vm, greatest(stddev_pop(v), 1e-6) AS vs FROM logs JOIN trained USING (group_id)),
timed AS (SELECT adj.group_id, adj.src, adj.dst, [coalesce((m - mm) / ms, 0.0::DOUBLE), coalesce((v - vm) / vs, 0.0::DOUBLE)] AS t
  FROM adj LEFT JOIN logs USING (group_id, src, dst), fit),
{residual('timed', 'group_id, src, dst', 2, 'e')},
arriving AS (SELECT group_id, dst AS node_id, h, 0.05::DOUBLE * sum(v) AS v FROM e GROUP BY group_id, dst, h),
first_ AS (SELECT group_id, node_id, h, greatest(sum(moved.v * wt) + any_value(arriving.v), 0.0::DOUBLE) AS v
  FROM moved JOIN w1 USING (d) JOIN arriving USING (group_id, node_id, h) GROUP BY group_id, node_id, h),
mapped AS (SELECT group_id, node_id, w2.h, sum(v * wt) AS v FROM first_ JOIN w2 ON w2.d = first_.h GROUP BY group_id, node_id, w2.h),
second_ AS (SELECT a.group_id, a.dst AS node_id, h, sum(a.w * mapped.v) AS v FROM adj a
  JOIN mapped ON mapped.group_id = a.group_id AND mapped.node_id = a.src GROUP BY a.group_id, a.dst, h),
z AS (SELECT group_id, h, avg(second_.v + arriving.v) AS v FROM second_ JOIN arriving USING (group_id, node_id, h) GROUP BY group_id, h),
{CENTRED.format(z='z')}
{SCORED.format(z='z')}"""


def inception(rounds: int) -> str:
    """Blocks x -> (x + A1 x + A2 x) W, as all three weights of a block are the same formula."""
    parts = []
    for k in range(rounds):
        source = f"y{k}"
        parts.append(f"""t{k} AS (SELECT group_id, node_id, d, sum(v) AS v FROM (
  SELECT group_id, node_id, d, v FROM {source}
  UNION ALL SELECT a.group_id, a.dst, d, a.w * v FROM adj a JOIN {source} y ON y.group_id = a.group_id AND y.node_id = a.src
  UNION ALL SELECT a.group_id, a.dst, d, a.w * v FROM second a JOIN {source} y ON y.group_id = a.group_id AND y.node_id = a.src)
  GROUP BY group_id, node_id, d),
y{k + 1} AS (SELECT group_id, node_id, h AS d, sum(v * wt) AS v FROM t{k} JOIN w{1 if k == 0 else 2} USING (d) GROUP BY group_id, node_id, h)""")
    return ", ".join(parts)


ORACLE["encode_inception"] = f"""{RECURSIVE}{WEIGHTED}, {RANKED}, {balanced('p', 'adj')}, {SECOND}, {X}, {XD},
{weights(DIMS, HIDDEN, 'w1')}, {weights(HIDDEN, HIDDEN, 'w2')},
y0 AS (SELECT group_id, node_id, d, v FROM xd), {inception(3)},
packed AS (SELECT group_id, node_id, list(v ORDER BY d) AS x FROM y3 GROUP BY group_id, node_id)
SELECT group_id, node_id, {micro('x', 'x')} FROM packed"""

# --- metrics
SCORES = """scores AS (SELECT CAST(doc_id AS VARCHAR) AS group_id, lang, source, toxic AS label, CAST(n_chars AS DOUBLE) AS score
  FROM documents JOIN labels USING (doc_id))"""


def cumulative(*by: str) -> str:
    """Counts per distinct score and their running sums by descending score."""
    keys = "".join(f"{k}, " for k in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""ties AS (SELECT {keys}score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY {keys}score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS step,
    sum(pos) OVER ({part}) AS positives, sum(neg) OVER ({part}) AS negatives
  FROM ties WINDOW w AS ({part}ORDER BY score DESC))"""


AUC = "round(sum(pos * (negatives - fp + neg / 2.0::DOUBLE)) / nullif(any_value(positives)::DOUBLE * any_value(negatives), 0), 6)"
AP = "round(sum(pos::DOUBLE / nullif(positives, 0) * tp / (tp + fp)), 6)"
ORACLE["roc_auc"] = f"{with_(SCORES, cumulative('lang'))} SELECT lang, {AUC} AS roc_auc FROM cum GROUP BY lang"
ORACLE["average_precision"] = f"{with_(SCORES, cumulative())} SELECT {AP} AS average_precision FROM cum"
ORACLE["metric_table"] = f"""{with_(SCORES, cumulative('lang', 'source'))}
SELECT lang, source, CAST(any_value(positives) AS BIGINT) AS positives, CAST(any_value(negatives) AS BIGINT) AS negatives,
  {AUC} AS roc_auc, {AP} AS average_precision FROM cum GROUP BY lang, source"""
ORACLE["tie_ranks"] = f"""{with_(SCORES)}, r AS (SELECT score, label, rank() OVER (ORDER BY score) AS low, count(*) OVER (PARTITION BY score) AS n FROM scores)
SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, any_value(low) + (any_value(n) - 1) / 2.0::DOUBLE AS avg_rank
FROM r GROUP BY score"""
ROC = "round(fp / nullif(negatives, 0)::DOUBLE, 6) AS fpr, round(tp / nullif(positives, 0)::DOUBLE, 6) AS tpr"
ORACLE["roc_points"] = f"""{with_(SCORES, cumulative('lang'))}
SELECT lang, step, {ROC}, score AS threshold FROM cum
UNION ALL SELECT DISTINCT lang, 0, 0.0, 0.0, NULL FROM scores"""
ORACLE["roc_corners"] = f"""{with_(SCORES, cumulative())},
n AS (SELECT *, lead(pos) OVER (ORDER BY step) AS np, lead(neg) OVER (ORDER BY step) AS nn FROM cum)
SELECT step, {ROC} FROM n WHERE np IS NULL OR pos * nn <> neg * np UNION ALL SELECT 0, 0.0, 0.0"""
ORACLE["pr_points"] = f"""{with_(SCORES, cumulative())}
SELECT step, round(tp / positives::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision, score AS threshold FROM cum
UNION ALL SELECT 0, 0.0, 1.0, NULL"""
ORACLE["curve_area"] = f"""{with_(SCORES, cumulative('lang'))},
points AS (SELECT lang, step, fp / nullif(negatives, 0)::DOUBLE AS x, tp / nullif(positives, 0)::DOUBLE AS y FROM cum
  UNION ALL SELECT DISTINCT lang, 0, 0.0, 0.0 FROM scores),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM points WINDOW w AS (PARTITION BY lang ORDER BY step))
SELECT lang, round(sum((nx - x) * (ny + y) / 2), 6) AS area FROM n GROUP BY lang"""
RESULTS = f"""{SCORES}, {cumulative('source', 'lang')},
results AS (SELECT source AS config, lang AS seed, {AUC} AS val_roc, {AP} AS val_prc FROM cum GROUP BY source, lang)"""
_aggregates = ", ".join(
    f"round({fn}({m}), 6) AS {m}_{name}"
    for m in ("val_roc", "val_prc")
    for name, fn in (("mean", "avg"), ("std_pop", "stddev_pop"), ("std_samp", "stddev_samp"), ("peak", "max"))
)
_exact = RESULTS.replace(AUC, AUC[len("round("):-len(", 6)")]).replace(AP, AP[len("round("):-len(", 6)")])
ORACLE["seed_summary"] = f"{with_(_exact)} SELECT config, {_aggregates} FROM results GROUP BY config"
ORACLE["best_config"] = f"""{with_(RESULTS)} SELECT * FROM results WHERE val_roc IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY seed ORDER BY val_roc DESC, config) = 1"""

# --- root causes
CAUSES = f"""{LOOPED}, {LABELS},
top AS (SELECT group_id, event AS node, n::DOUBLE / max(n) OVER (PARTITION BY group_id) AS importance, first_pos
  FROM nodes JOIN labels_ USING (group_id) WHERE label = 1),
kept AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY importance DESC, node) <= {TOP_K}),
among AS (SELECT e.group_id, src_event AS src, dst_event AS dst, e.n::DOUBLE AS frequency, d.importance AS ti,
    CASE WHEN s.first_pos <= d.first_pos THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END AS precedence
  FROM edges e JOIN kept s ON s.group_id = e.group_id AND s.node = src_event
  JOIN kept d ON d.group_id = e.group_id AND d.node = dst_event),
cedges AS (SELECT group_id, src, dst, frequency, ti, least(greatest(0.55::DOUBLE * frequency / max(frequency) OVER (PARTITION BY group_id)
    + 0.25::DOUBLE * precedence + 0.20::DOUBLE * ti, 0), 1) AS confidence FROM among)"""
PATHS = f"""paths AS (
  SELECT group_id, src AS root, [src, dst] AS path, dst AS tail, confidence, ti FROM cedges WHERE src <> dst
  UNION ALL
  SELECT p.group_id, root, list_append(path, dst), dst, p.confidence * c.confidence, c.ti
  FROM paths p JOIN cedges c ON c.group_id = p.group_id AND c.src = p.tail
  WHERE NOT list_contains(path, dst) AND len(path) <= {MAX_HOPS})"""
ROOTS = """raw AS (SELECT k.group_id, k.node, (k.importance + coalesce(r.reach, 0)) / (1 + coalesce(d.deg, 0)) AS raw
  FROM kept k LEFT JOIN (SELECT group_id, root AS node, sum(confidence * ti) AS reach FROM paths GROUP BY group_id, root) r USING (group_id, node)
  LEFT JOIN (SELECT group_id, dst AS node, count(*) AS deg FROM cedges GROUP BY group_id, dst) d USING (group_id, node)),
roots AS (SELECT group_id, node, raw / max(raw) OVER (PARTITION BY group_id) AS score FROM raw)"""
ORACLE["influential_subgraph"] = f"{with_(CAUSES)} SELECT group_id, node AS src, NULL::VARCHAR AS dst, round(importance, 6) AS size FROM kept UNION ALL SELECT group_id, src, dst, frequency FROM among"
ORACLE["causal_edges"] = f"""{with_(CAUSES)} SELECT group_id, src, dst, round(confidence, 6) AS confidence, frequency,
  CAST(row_number() OVER (PARTITION BY group_id ORDER BY round(confidence, 9) DESC, src, dst) AS INTEGER) AS rank FROM cedges"""
ORACLE["simple_paths"] = (
    f"{RECURSIVE}{CAUSES}, {PATHS} SELECT group_id, array_to_string(path, '>') AS path, round(confidence, 6) AS confidence FROM paths"
)
ORACLE["root_ranking"] = f"{RECURSIVE}{CAUSES}, {PATHS}, {ROOTS} SELECT group_id, node, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, node) AS INTEGER) AS rank FROM roots"
ORACLE["causal_chains"] = f"""{RECURSIVE}{CAUSES}, {PATHS}, {ROOTS},
chains AS (SELECT p.group_id, path, score * confidence * ti AS confidence FROM paths p JOIN roots r ON r.group_id = p.group_id AND r.node = p.root)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY round(confidence, 9) DESC, array_to_string(path, '>')) AS INTEGER) AS rank,
  array_to_string(path, '>') AS path, round(confidence, 6) AS confidence FROM chains WHERE confidence > 0 QUALIFY rank <= {CHAIN_LIMIT}"""

# --- further checks, and tables written and read back
ORACLE["keyed_props"] = r"""SELECT event_id, 'blk_-' || event_id AS block, nullif(regexp_extract(props, '\d\d+'), '') AS key FROM events"""
ORACLE["times_or_positions"] = f"""{with_(DAY_LOG, STEPS)} SELECT group_id, event_id,
  round(CASE WHEN event = 'view' OR value IS NULL THEN pos::DOUBLE ELSE value END, 6) AS t FROM steps"""
ORACLE["first_fields"] = f"""{with_(DAY_LOG)} SELECT event_id, CASE WHEN event IN ('view', 'click') THEN message ELSE event END AS field,
  CASE WHEN event = 'error' THEN message ELSE event END AS name FROM log"""
ORACLE["short_vectors"] = f"""WITH v AS (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, {micro('x', 'x')} FROM v"""
ORACLE["normal_test_graphs"] = f"""{with_(LOOPED, GRAPHS, LABELS, COIN)}
SELECT graphs.*, label FROM graphs JOIN splits USING (group_id) WHERE split = 'test' AND label = 0"""
ORACLE["all_groups"] = ORACLE["group_labels"]
ORACLE["sorted_edges"] = ORACLE["transition_edges"]
ORACLE["stored_graphs"] = ORACLE["transition_edges"]
ORACLE["checked_graphs"] = f"{with_(LOOPED, GRAPHS)} SELECT * FROM graphs"
ORACLE["graphs_with_timing"] = f"""{with_(LOOPED, GRAPHS, GAPS)} SELECT group_id, n_events, n_edges,
  round(gap_mean, 6) AS gap_mean, round(gap_max, 6) AS gap_max FROM graphs JOIN gaps USING (group_id)"""
ORACLE["edge_timing"] = f"""{with_(WEIGHTED, UNDIRECTED, LABELS, COIN)},
logs AS (SELECT group_id, src, dst, ln(1 + mean_dt) AS m, ln(1 + var_dt) AS v FROM edges),
fit AS (SELECT avg(m) AS mm, greatest(stddev_pop(m), 1e-6) AS ms, avg(v) AS vm, greatest(stddev_pop(v), 1e-6) AS vs
  FROM logs JOIN splits USING (group_id) WHERE split = 'train' AND label = 0),
timed AS (SELECT a.group_id, a.src, a.dst, a.w, [coalesce((m - mm) / ms, 0), coalesce((v - vm) / vs, 0)] AS t
  FROM adj a CROSS JOIN fit LEFT JOIN logs l ON l.group_id = a.group_id AND l.src = a.src AND l.dst = a.dst)
SELECT group_id, src, dst, round(w, 6) AS w, {micro('t', 't')} FROM timed"""
ORACLE["best_epoch"] = """WITH h AS (SELECT source, lang, round(avg(n_chars), 6) AS loss,
  row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS epoch FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source, lang)
SELECT source, epoch, loss FROM h WHERE epoch > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY loss, epoch) = 1"""
ORACLE["stored_log"] = f"""{with_(DAY_LOG)} SELECT group_id, event_id AS seq, 'a "b", c|' || message AS event, round(ts_s, 6) AS ts_s FROM log"""
ORACLE["stored_free_log"] = f"""{with_(DAY_LOG)} SELECT group_id, event_id AS seq, CASE WHEN event = 'error' THEN message ELSE event END AS event,
  label, round(CASE WHEN event = 'view' THEN row_number() OVER (PARTITION BY group_id ORDER BY event_id) - 1 ELSE ts_s END, 6) AS ts_s FROM log"""
ORACLE["stored_labels"] = ORACLE["group_labels"]
ORACLE["stored_vectors"] = f"WITH {VECTORS} SELECT event, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS d, round(unnest(vec), 6) AS v FROM vectors"
ORACLE["stored_splits"] = ORACLE["protocol_splits"]
ORACLE["stored_split_ids"] = ORACLE["protocol_splits"]
NUMBERED = "numbered AS (SELECT group_id, CAST(row_number() OVER (ORDER BY group_id) AS VARCHAR) AS graph_no FROM graphs)"
ORACLE["bundle_nodes"] = f"""{with_(LOOPED, GRAPHS, LABELS, NUMBERED)}
SELECT graph_no AS group_id, label, node_id, n::DOUBLE AS n, round(first_pos / 3.0::DOUBLE, 6) AS third
FROM nodes JOIN numbered USING (group_id) JOIN labels_ USING (group_id)"""
ORACLE["bundle_edges"] = f"""{with_(WEIGHTED, UNDIRECTED, GRAPHS, NUMBERED)}
SELECT graph_no AS group_id, src, dst, round(w, 6) AS w FROM adj JOIN numbered USING (group_id)"""
ORACLE["stored_predictions"] = f"{with_(SCORES)} SELECT group_id, label, score FROM scores"
ORACLE["stored_curves"] = f"""{with_(SCORES, cumulative())}
SELECT 'roc' AS curve, step, round(fp / negatives::DOUBLE, 6) AS x, round(tp / positives::DOUBLE, 6) AS y FROM cum
UNION ALL SELECT 'roc', 0, 0.0, 0.0
UNION ALL SELECT 'pr', step, round(tp / positives::DOUBLE, 6), round(tp / (tp + fp)::DOUBLE, 6) FROM cum
UNION ALL SELECT 'pr', 0, 0.0, 1.0"""
ORACLE["stored_results"] = f"""{with_(_exact)} SELECT config || '/' || seed AS config, CAST(unnest([{SEED}, {SEED + 1}]) AS INTEGER) AS seed,
  round(val_roc, 6) AS val_roc, round(val_prc, 6) AS val_prc, round(1 - val_roc, 6) AS test_roc, round(val_prc, 6) AS test_prc FROM results"""
ORACLE["stored_structured_log"] = f"""{with_(DAY_LOG)}
SELECT group_id, event_id AS seq, event AS event_id, message AS event, round(ts_s, 6) AS ts_s,
  CASE WHEN label = 1 THEN 'ERROR' ELSE 'INFO' END AS level FROM log"""
ORACLE["stored_model_scores"] = f"""{RECURSIVE}{WEIGHTED}, {LABELS}, {COIN}, {TRAINED}, {FORWARD}, {CENTRED.format(z='z')}
{SCORED.format(z='z')}"""
ORACLE["joined_splits"] = ORACLE["bernoulli_split"]
