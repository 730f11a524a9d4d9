"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

HOUR = 3_600_000_000
DAY = 24 * HOUR
US_4H = 4 * HOUR
BINS = (2, 3, 4, 6, 8, 10)

EVENTS = "ev AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS source, json_extract_string(props, '$.k') AS target, epoch_us(ts) AS t_us, value AS amount, CAST(event_type = 'error' AS INT) AS label, event_id AS seq FROM events)"
ITEMS = "it AS (SELECT l_orderkey || '-' || l_linenumber AS given, CAST(l_partkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS target, epoch_us(l_shipdate) AS t_us, l_extendedprice AS amount, CAST(l_returnflag = 'R' AS INT) AS label, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS seq FROM lineitem)"
#: Ids that occur once stay; no given id looks like a repaired one.
REPAIRED = "rp AS (SELECT CASE WHEN count(*) OVER (PARTITION BY given) = 1 THEN given ELSE 'tx_' || seq END AS transaction_id, * FROM it)"


def successors(name: str, source: str, delta: int) -> str:
    return f"{name} AS (SELECT a.transaction_id AS source_transaction_id, b.transaction_id AS target_transaction_id, a.target AS via_account, b.t_us - a.t_us AS time_delta_us, b.t_us AS edge_us FROM {source} a JOIN {source} b ON a.target = b.source AND b.t_us > a.t_us AND b.t_us <= a.t_us + {delta})"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def snapshots(table: str, bin_us: int, stride_us: int, drop_last: bool, context: int = 0) -> list[str]:
    """CTEs: w (window_start, window_end), tagged (row, window, is_target), num (window_start, snapshot_index)."""
    stop = f"hi - {bin_us}" if drop_last else "hi - 1"
    return [
        f"bd AS (SELECT min(t_us) AS lo, max(t_us) + 1 AS hi FROM {table})",
        f"w AS (SELECT s AS window_start, least(s + {bin_us}, hi) AS window_end FROM (SELECT unnest(range(lo, {stop} + 1, {stride_us})) AS s, hi FROM bd))",
        f"tagged AS (SELECT x.*, w.window_start, w.window_end, x.t_us >= w.window_start AS is_target FROM {table} x JOIN w ON x.t_us >= w.window_start - {context} AND x.t_us < w.window_end)",
        "num AS (SELECT window_start, row_number() OVER (ORDER BY window_start) AS snapshot_index FROM (SELECT DISTINCT window_start FROM tagged WHERE is_target))",
        "snap AS (SELECT * FROM tagged JOIN num USING (window_start))",
    ]


_SIZES = """, n AS (SELECT snapshot_index, count(*) AS n_nodes FROM (SELECT snapshot_index, source AS a FROM snap UNION SELECT snapshot_index, target FROM snap) GROUP BY ALL)
SELECT snapshot_index, window_start, window_end, count(*) AS n_edges, round(sum(amount), 6) AS amount, any_value(n_nodes) AS n_nodes FROM snap JOIN n USING (snapshot_index) GROUP BY snapshot_index, window_start, window_end"""

# ---- graph features ----


def batches(size: int | None, keep: int) -> list[str]:
    """CTEs: r (rows with batch b), ends (b, latest), vis (b and each edge that the batch sees: eb its own batch)."""
    b = "0" if size is None else f"seq // {size}"
    return [
        EVENTS, f"r AS (SELECT transaction_id AS eid, source AS u, target AS v, t_us AS t, seq, amount, {b} AS b FROM ev)", "ends AS (SELECT b, max(t) AS latest FROM r GROUP BY b)",
        f"vis AS (SELECT ends.b, ends.latest, r.eid, r.u, r.v, r.t, r.seq, r.amount, r.b AS eb FROM ends JOIN r ON r.b <= ends.b AND r.t > ends.latest - {keep})",
    ]


def bins_of(value: str, bins: tuple[int, ...], name: str, weight: str = "1") -> str:
    out = []
    for k, low in enumerate(bins):
        high = f" AND {value} < {bins[k + 1]}" if k + 1 < len(bins) else ""
        out.append(f"CAST(coalesce(sum(CASE WHEN {value} >= {low}{high} THEN {weight} END), 0) AS BIGINT) AS {name}_{k}")
    return ", ".join(out)


def histogram(name: str, tw: int, size: int | None = 512, keep: int = DAY, bins: tuple[int, ...] = BINS, rows: list[str] | None = None) -> str:
    """rows: CTEs in place of batches(), for graphs with a history (b < 0) or repeated ids."""
    kind, side = name.split("_")
    mine, nbr = ("v", "u") if side == "in" else ("u", "v")
    count = f"count(DISTINCT {nbr})" if kind == "fan" else "count(*)"
    parts = (rows or batches(size, keep)) + [
        f"sized AS (SELECT b, eb, eid, {mine} AS vx, t, {count} OVER (PARTITION BY b, {mine} ORDER BY t RANGE BETWEEN {tw - 1} PRECEDING AND CURRENT ROW) AS n FROM vis)",
        f"hit AS (SELECT r.seq, s.n FROM r JOIN vis me ON me.b = r.b AND me.eid = r.eid AND me.{mine} = r.{mine} JOIN sized s ON s.b = r.b AND s.eb = s.b AND s.vx = r.{mine} AND s.t >= r.t AND s.t - r.t < {tw})",
        f"{name}_h AS (SELECT seq, {bins_of('n', bins, name)} FROM hit GROUP BY seq)",
    ]
    names = ", ".join(f"coalesce({name}_{k}, 0) AS {name}_{k}" for k in range(len(bins)))
    return with_(*parts) + f"SELECT r.seq, {names} FROM r LEFT JOIN {name}_h USING (seq) WHERE b >= 0"


def _statistics(stats: tuple[str, ...], window: int) -> list[str]:
    out = []
    made = {
        "fan": "count(DISTINCT nbr)", "degree": "count(*)", "ratio": "round(count(*) / count(DISTINCT nbr), 6)", "mean": "round(any_value(mu), 6)", "sum": "round(sum(amount), 6)", "min": "round(min(amount), 6)", "max": "round(max(amount), 6)",
        "median": "round(median(amount), 6)", "var": "round(avg((amount - mu) ** 2), 6)",
        "skew": "round(CASE WHEN avg((amount - mu) ** 2) < 1e-12 THEN 0 ELSE avg((amount - mu) ** 3) / avg((amount - mu) ** 2) ** 1.5 END, 6) + 0.0",
        "kurtosis": "round(CASE WHEN avg((amount - mu) ** 2) < 1e-12 THEN 0 ELSE avg((amount - mu) ** 4) / avg((amount - mu) ** 2) ** 2 END, 6)",
    }
    for end, col in (("source", "u"), ("target", "v")):
        for side in ("out", "in"):
            mine, nbr = ("u", "v") if side == "out" else ("v", "u")
            p = f"{end}_{side}"
            cols = ", ".join(f"{made[s]} AS {p}_{s}{'' if s in ('fan', 'degree', 'ratio') else '_amount'}" for s in stats)
            out.append(f"{p}_r AS (SELECT r.seq, e.{nbr} AS nbr, e.amount, avg(e.amount) OVER (PARTITION BY r.seq) AS mu FROM r JOIN vis e ON e.b = r.b AND e.{mine} = r.{col} AND e.t >= r.t - {window})")
            out.append(f"{p}_s AS (SELECT seq, {cols} FROM {p}_r GROUP BY seq)")
    return out


def statistics(stats: tuple[str, ...], window: int, keep: int, size: int | None = 512, more: str = "", more_cols: str = "") -> str:
    cols = ", ".join(f"coalesce({e}_{s}_{x}{'' if x in ('fan', 'degree', 'ratio') else '_amount'}, 0) AS {e}_{s}_{x}{'' if x in ('fan', 'degree', 'ratio') else '_amount'}" for e in ("source", "target") for s in ("out", "in") for x in stats)
    joins = " ".join(f"LEFT JOIN {e}_{s}_s USING (seq)" for e in ("source", "target") for s in ("out", "in"))
    return with_(*batches(size, keep), *_statistics(stats, window)) + f"SELECT r.seq, {cols} FROM r {joins}"


def scatter_gather(tw: int, keep: int, bins: tuple[int, ...]) -> str:
    parts = batches(512, keep) + [
        f"d AS (SELECT DISTINCT b, u, v FROM vis WHERE t >= latest - {tw})",
        "p2 AS (SELECT x.b, x.u AS a, y.v AS z, count(*) AS n FROM d x JOIN d y ON x.b = y.b AND x.v = y.u GROUP BY ALL HAVING count(*) >= 2)",
        "roles AS (SELECT r.seq, p2.n FROM r JOIN d ON d.b = r.b AND d.u = r.v AND d.v <> r.u JOIN p2 ON p2.b = r.b AND p2.a = r.u AND p2.z = d.v UNION ALL SELECT r.seq, p2.n FROM r JOIN d ON d.b = r.b AND d.v = r.u AND d.u <> r.v JOIN p2 ON p2.b = r.b AND p2.a = d.u AND p2.z = r.v)",
        f"h AS (SELECT seq, {bins_of('n', bins, 'scatter_gather')} FROM roles GROUP BY seq)",
    ]
    return with_(*parts) + "SELECT r.seq, " + ", ".join(f"coalesce(scatter_gather_{k}, 0) AS scatter_gather_{k}" for k in range(len(bins))) + " FROM r LEFT JOIN h USING (seq)"


def cycles(name: str, tw: int, keep: int, bins: tuple[int, ...], longest: int = 0) -> str:
    """longest 0: of any length, as paths repeat no account."""
    timed = name == "temporal_cycle"
    down = "w.downs + CAST(e.t <= w.prev AS INT)" if timed else "0"
    go = f" AND {down} <= 1 AND ({down} = 0 OR e.t < w.t0)" if timed else ""
    close = f" AND {down} + CAST(w.t0 <= e.t AS INT) = 1" if timed else ""
    bound = f" AND len(w.path) < {longest}" if longest else ""
    parts = batches(512, keep) + [
        f"ew AS (SELECT {'' if timed else 'DISTINCT '}b, u, v{', t' if timed else ', 0 AS t'} FROM vis WHERE t >= latest - {tw})",
        f"""w AS (SELECT b, seq, u, [u, v] AS path, v AS last, t AS t0, t AS prev, 0 AS downs FROM r WHERE u <> v
  UNION SELECT w.b, w.seq, w.u, list_append(w.path, e.v), e.v, w.t0, {'e.t' if timed else 'w.prev'}, {down} FROM w JOIN ew e ON e.b = w.b AND e.u = w.last WHERE NOT list_contains(w.path, e.v){go}{bound})""",
        f"done AS (SELECT DISTINCT w.seq, w.path, len(w.path) AS n FROM w JOIN ew e ON e.b = w.b AND e.u = w.last AND e.v = w.u WHERE true{go}{close})",
        f"h AS (SELECT seq, {bins_of('n', bins, name)} FROM done GROUP BY seq)",
    ]
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT r.seq, " + ", ".join(f"coalesce({name}_{k}, 0) AS {name}_{k}" for k in range(len(bins))) + " FROM r LEFT JOIN h USING (seq)"


# ---- sampling ----

_HOPS = """, sd AS (SELECT transaction_id AS seed_id, t_us AS seed_us, transaction_id AS frontier_id FROM ev WHERE label = 1),
c1 AS (SELECT seed_id, seed_us, frontier_id, source_transaction_id AS context_id, c.t_us AS context_us FROM sd JOIN e ON e.target_transaction_id = frontier_id JOIN ev c ON c.transaction_id = source_transaction_id WHERE c.t_us < seed_us
  QUALIFY row_number() OVER (PARTITION BY seed_id, frontier_id ORDER BY c.t_us DESC, source_transaction_id DESC) <= {0})"""
_HOP2 = """, f2 AS (SELECT DISTINCT seed_id, seed_us, context_id AS frontier_id FROM c1),
c2 AS (SELECT seed_id, frontier_id, source_transaction_id AS context_id, c.t_us AS context_us FROM f2 JOIN e ON e.target_transaction_id = frontier_id JOIN ev c ON c.transaction_id = source_transaction_id WHERE c.t_us < seed_us
  QUALIFY row_number() OVER (PARTITION BY seed_id, frontier_id ORDER BY c.t_us DESC, source_transaction_id DESC) <= {0})"""


def event_hops(first: int) -> str:
    return f"""fr AS (SELECT seq AS target_id, t_us AS target_us, unnest(list_distinct([source, target])) AS account FROM ev WHERE label = 1),
h1 AS (SELECT target_id, target_us, account, x.source AS nxt, x.seq AS event_id, x.t_us AS event_us FROM fr JOIN ev x ON x.target = account AND x.t_us < target_us
  QUALIFY row_number() OVER (PARTITION BY target_id, account ORDER BY x.t_us DESC, x.seq DESC) <= {first})"""


def _score(threshold: float) -> str:
    return f"""sc AS (SELECT seq, amount / (amount + 1) AS score, label FROM ev),
cm AS (SELECT count(*) FILTER (score >= {threshold} AND label = 1) AS tp, count(*) FILTER (score >= {threshold} AND label <> 1) AS fp, count(*) FILTER (score < {threshold} AND label <> 1) AS tn, count(*) FILTER (score < {threshold} AND label = 1) AS fn FROM sc),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cm),
th AS (SELECT tp, fp, tn, fn, round(p, 6) AS threshold_precision, round(r, 6) AS threshold_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS threshold_f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS threshold_accuracy, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS threshold_false_positive_rate FROM pr),
g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM g),
rk AS (SELECT round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS average_precision, round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM cum)"""


def _at_k(ks: tuple[int, ...]) -> str:
    return f"""o AS (SELECT label, row_number() OVER (ORDER BY score DESC, seq) AS rn FROM sc),
ak AS (SELECT k, sum(label) AS tp, sum(label) / k AS p, sum(label) / (SELECT sum(label) FROM sc) AS r FROM o JOIN (SELECT unnest({list(ks)}) AS k) ON rn <= k GROUP BY k),
atk AS (SELECT k, CAST(tp AS BIGINT) AS tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(p / (SELECT avg(label) FROM sc), 6) AS lift FROM ak)"""


_FLOW = """f AS (SELECT account, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(1 - o) AS BIGINT) AS n_in, round(coalesce(sum(amount) FILTER (o = 1), 0), 6) AS amount_out, round(coalesce(sum(amount) FILTER (o = 0), 0), 6) AS amount_in
  FROM (SELECT source AS account, 1 AS o, amount FROM ev UNION ALL SELECT target, 0, amount FROM ev) GROUP BY account)"""
_CUTS = "ct AS (SELECT lo + (hi - 1 - lo) * 3 // 5 AS a, lo + (hi - 1 - lo) * 4 // 5 AS z FROM (SELECT min(t_us) AS lo, max(t_us) + 1 AS hi FROM ev))"
_INDEX = "ix AS (SELECT node_id, row_number() OVER (ORDER BY CAST(node_id AS BIGINT)) - 1 AS k FROM (SELECT source AS node_id FROM ev UNION SELECT target FROM ev))"

SQL = {
    "canonical_transactions": with_(ITEMS) + "SELECT 'tx_' || seq AS transaction_id, source, target, t_us - t_us % 86400000000 + 38119000000 AS t_us, amount, label FROM it",
    "clean_median_impute": """
WITH k AS (SELECT CAST(o_custkey AS VARCHAR) AS source, CAST(o_orderkey AS VARCHAR) AS target, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE 'UNKNOWN' END AS category,
  epoch_us(date_trunc('minute', o_orderdate)) AS t_us, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS timestamp__raw FROM orders WHERE o_orderkey % 7 <> 0)
SELECT source, target, round(coalesce(amount, (SELECT median(amount) FROM k)), 6) AS amount, category, t_us, timestamp__raw FROM k""",
    "parse_time_forms": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(date_trunc('minute', o_orderdate)) WHEN 2 THEN epoch_us(date_trunc('day', o_orderdate)) WHEN 3 THEN epoch_us(date_trunc('minute', o_orderdate)) END AS t_us FROM orders",
    "logical_timestamp": "SELECT l_linenumber, epoch_us(TIMESTAMP '2020-01-01') + l_linenumber * 3600000000 AS t_us, count(*) AS n FROM lineitem GROUP BY ALL",
    "id_repair": with_(ITEMS, REPAIRED) + "SELECT transaction_id, source, target, t_us, amount FROM rp",
    "account_nodes": with_(EVENTS) + "SELECT source AS node_id FROM ev UNION SELECT target FROM ev",
    "account_edges": with_(EVENTS) + "SELECT transaction_id, source, target, t_us, amount, label FROM ev",
    "account_metadata": with_(EVENTS) + "SELECT node_id, c_acctbal, c_mktsegment FROM (SELECT source AS node_id FROM ev UNION SELECT target FROM ev) LEFT JOIN customer ON node_id = CAST(c_custkey AS VARCHAR)",
    "tx_graph_edges_4h": with_(EVENTS, successors("e", "ev", US_4H)) + "SELECT source_transaction_id, target_transaction_id, via_account, time_delta_us FROM e",
    "tx_graph_edges_1d": with_(EVENTS, successors("e", "ev", DAY)) + "SELECT source_transaction_id, target_transaction_id, via_account, time_delta_us FROM e",
    "tx_graph_edges_ties": with_(ITEMS, REPAIRED, successors("e", "rp", 7 * DAY)) + "SELECT via_account, time_delta_us, count(*) AS n FROM e GROUP BY ALL",
    "successor_flow": with_(EVENTS, successors("e", "ev", US_4H), _FLOW) + "SELECT account, n_out, n_in, amount_out, amount_in, coalesce(n_passed, 0) AS n_passed, fastest_us FROM f LEFT JOIN (SELECT via_account AS account, count(*) AS n_passed, min(time_delta_us) AS fastest_us FROM e GROUP BY ALL) USING (account)",
    "unknown_endpoints": "SELECT transaction_id FROM (SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id FROM lineitem UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem) WHERE transaction_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 <> 0)",
    "precomputed_graph": """
SELECT CAST(prev AS VARCHAR) AS source_transaction_id, CAST(o_orderkey AS VARCHAR) AS target_transaction_id, 'precomputed' AS edge_relation, o_orderkey % 49 * 86400000000 AS t_us,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 0 END AS label
FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL""",
    "event_stream": with_(ITEMS, REPAIRED) + "SELECT seq, transaction_id, source, target, t_us, amount FROM rp",
    "order_guard": "WITH x AS (SELECT row_number() OVER o - 1 AS seq, epoch_us(l_shipdate) AS t_us, lag(l_shipdate) OVER o > l_shipdate AS bad FROM lineitem WINDOW o AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) SELECT seq, t_us FROM x WHERE bad",
    "edge_index": with_(EVENTS, _INDEX) + "SELECT seq, a.k AS source_index, b.k AS target_index FROM ev JOIN ix a ON a.node_id = source JOIN ix b ON b.node_id = target",
    "edge_times": with_(EVENTS, successors("e", "ev", US_4H)) + "SELECT source_transaction_id, target_transaction_id, edge_us * 1000 AS edge_time FROM e",
    "temporal_table": with_(EVENTS, _INDEX) + "SELECT seq, a.k AS src, b.k AS dst, t_us * 1000 AS t, round(CAST(CAST(amount AS FLOAT) AS DOUBLE), 3) AS m0, CAST(label AS DOUBLE) AS m1, label AS y FROM ev JOIN ix a ON a.node_id = source JOIN ix b ON b.node_id = target",
    "account_dictionary": with_(ITEMS) + "SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS code FROM (SELECT source AS node_id FROM it UNION SELECT target FROM it)",
    "account_snapshots_daily": with_(EVENTS, *snapshots("ev", DAY, DAY, True)) + _SIZES,
    "account_snapshots_sliding": with_(EVENTS, *snapshots("ev", 3 * DAY, 2 * DAY, False)) + _SIZES,
    "account_snapshot_rows": with_(EVENTS, *snapshots("ev", 2 * DAY, DAY, True)) + "SELECT snapshot_index, transaction_id FROM snap",
    "tx_snapshot_nodes": with_(EVENTS, *snapshots("ev", 2 * DAY, 2 * DAY, True, US_4H)) + "SELECT snapshot_index, transaction_id, is_target FROM snap",
    "tx_snapshot_edges": with_(EVENTS, successors("e", "ev", US_4H), *snapshots("ev", 2 * DAY, 2 * DAY, True, US_4H)) + "SELECT a.snapshot_index, source_transaction_id, target_transaction_id FROM e JOIN snap a ON a.transaction_id = source_transaction_id JOIN snap b ON b.transaction_id = target_transaction_id AND a.snapshot_index = b.snapshot_index",
    "static_windows": with_(ITEMS, "b AS (SELECT min(t_us) AS lo FROM it)", f"tg AS (SELECT (t_us - lo) // {90 * DAY} AS w, t_us, true AS is_target FROM it, b UNION ALL SELECT (t_us - lo) // {90 * DAY} + 1, t_us, false FROM it, b WHERE (t_us - lo) % {90 * DAY} >= {83 * DAY})", "nm AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS window_id FROM (SELECT DISTINCT w FROM tg WHERE is_target))")
    + "SELECT window_id, is_target, count(*) AS n, min(t_us) AS first_us FROM tg JOIN nm USING (w) GROUP BY ALL",
    "context_windows": with_(EVENTS, *snapshots("ev", DAY, DAY, True), "s AS (SELECT DISTINCT snapshot_index AS i FROM snap)") + "SELECT a.i AS target_index, CAST(b.i - a.i + 3 AS INT) AS position, b.i AS context_index FROM s a JOIN s b ON b.i BETWEEN a.i - 3 AND a.i - 1 WHERE a.i > 3",
    "disjoint_offsets": with_(EVENTS, *snapshots("ev", DAY, DAY, True), "n AS (SELECT snapshot_index, count(*) AS num_nodes FROM (SELECT snapshot_index, source AS a FROM snap UNION SELECT snapshot_index, target FROM snap) GROUP BY ALL)")
    + "SELECT (snapshot_index - 1) // 4 AS batch, snapshot_index, num_nodes, CAST(sum(num_nodes) OVER (PARTITION BY (snapshot_index - 1) // 4 ORDER BY snapshot_index) - num_nodes AS BIGINT) AS node_offset FROM n",
    "mini_batches": with_(ITEMS) + "SELECT seq // 1024 AS batch, count(*) AS n, min(t_us) AS low, max(t_us) AS high, round(sum(amount), 6) AS amount FROM it GROUP BY ALL",
    "induced_split": with_(EVENTS, successors("e", "ev", DAY), _CUTS, "pt AS (SELECT transaction_id, CASE WHEN t_us < a THEN 'train' WHEN t_us < z THEN 'validation' ELSE 'test' END AS split FROM ev, ct)")
    + "SELECT x.split, source_transaction_id, target_transaction_id FROM e JOIN pt x ON x.transaction_id = source_transaction_id JOIN pt y ON y.transaction_id = target_transaction_id AND x.split = y.split",
    "node_masks": with_(EVENTS, _CUTS) + "SELECT transaction_id, t_us < a AS train_mask, t_us >= a AND t_us < z AS validation_mask, t_us >= z AS test_mask FROM ev, ct",
    "count_split": with_(ITEMS, "n AS (SELECT count(*) AS n FROM it)", "c AS (SELECT max(CASE WHEN seq = n * 3 // 5 - 1 THEN t_us END) AS ta, max(CASE WHEN seq = n * 4 // 5 - 1 THEN t_us END) AS tz FROM it, n)")
    + "SELECT CASE WHEN t_us <= ta THEN 'train' WHEN t_us <= tz THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(t_us) AS low, max(t_us) AS high FROM it, c GROUP BY ALL",
    "time_bands": with_(EVENTS, "b AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM ev)") + "SELECT CAST(least(5, (t_us - lo) * 6 // (hi - lo)) AS INT) AS band, transaction_id FROM ev, b QUALIFY row_number() OVER (PARTITION BY least(5, (t_us - lo) * 6 // (hi - lo)) ORDER BY seq) <= 100",
    "threshold_metrics": with_(EVENTS, _score(0.98)) + "SELECT * FROM th",
    "ranking_metrics": with_(EVENTS, _score(0.98)) + "SELECT * FROM rk",
    "investigation_at_k": with_(EVENTS, _score(0.98), _at_k((10, 50, 200))) + "SELECT * FROM atk",
    "evaluation_bundle": with_(EVENTS, _score(0.98), _at_k((25,))) + "SELECT th.*, rk.*, precision AS precision_at_25, recall AS recall_at_25, f1 AS f1_at_25, lift AS lift_at_25 FROM th, rk, atk",
    "risk_from_logits": with_(EVENTS) + "SELECT seq, round(1 / (1 + exp(-(ln(1 + abs(amount)) - 3))), 6) AS risk FROM ev",
    **{f"gfp_{n}": histogram(n, DAY) for n in ("fan_in", "fan_out", "degree_in", "degree_out")},
    "gfp_scatter_gather": scatter_gather(12 * HOUR, DAY, (2, 3)),
    "gfp_length_cycle": cycles("length_cycle", 12 * HOUR, DAY, (2, 3, 4), 4),
    "gfp_temporal_cycle": cycles("temporal_cycle", 12 * HOUR, DAY, (2, 3, 4)),
    "gfp_statistics": statistics(("fan", "degree", "ratio", "mean", "sum", "min", "max", "median", "var", "skew", "kurtosis"), DAY, 2 * DAY),
    "gfp_single_batch": f"SELECT * FROM ({histogram('fan_in', DAY, None, 60 * DAY)}) JOIN ({histogram('degree_out', DAY, None, 60 * DAY)}) USING (seq)",
    "gfp_causal": f"SELECT * FROM ({histogram('fan_in', DAY, 1)}) JOIN ({statistics(('fan', 'degree', 'sum'), DAY, DAY, 1)}) USING (seq)",
    "active_edges": with_(EVENTS, "b AS (SELECT max(t_us) AS hi, max(seq) AS m FROM ev)") + f"SELECT transaction_id AS edge_id FROM ev, b WHERE t_us > hi - {DAY} AND seq > m - 250",
    "causal_neighbors_1hop": with_(EVENTS, successors("e", "ev", DAY)).rstrip() + _HOPS.format(5) + "SELECT seed_id, 1 AS hop, frontier_id, context_id, context_us FROM c1",
    "causal_neighbors_2hop": with_(EVENTS, successors("e", "ev", DAY)).rstrip() + _HOPS.format(3) + _HOP2.format(2) + "SELECT seed_id, 1 AS hop, frontier_id, context_id, context_us FROM c1 UNION ALL SELECT seed_id, 2, frontier_id, context_id, context_us FROM c2",
    "causal_neighbors_windowed": with_(
        EVENTS, successors("e", "ev", DAY), "b AS (SELECT min(t_us) AS lo FROM ev)", f"sd AS (SELECT (t_us - lo) // {2 * DAY} AS window_id, lo + (t_us - lo) // {2 * DAY} * {2 * DAY} - {12 * HOUR} AS floor, transaction_id AS seed_id, t_us AS seed_us FROM ev, b WHERE label = 1)",
    ) + "SELECT window_id, seed_id, 1 AS hop, seed_id AS frontier_id, source_transaction_id AS context_id, c.t_us AS context_us FROM sd JOIN e ON e.target_transaction_id = seed_id JOIN ev c ON c.transaction_id = source_transaction_id WHERE c.t_us < seed_us AND c.t_us >= floor QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY c.t_us DESC, source_transaction_id DESC) <= 3",
    "causal_event_neighbors": with_(EVENTS, event_hops(4), "f2 AS (SELECT DISTINCT target_id, target_us, nxt AS account FROM h1)", "h2 AS (SELECT target_id, account, x.seq AS event_id, x.t_us AS event_us FROM f2 JOIN ev x ON x.target = account AND x.t_us < target_us QUALIFY row_number() OVER (PARTITION BY target_id, account ORDER BY x.t_us DESC, x.seq DESC) <= 2)")
    + "SELECT target_id, 1 AS hop, account, event_id, event_us FROM h1 UNION ALL SELECT target_id, 2, account, event_id, event_us FROM h2",
    "uniform_neighbors": with_(EVENTS, successors("e", "ev", DAY)) + "SELECT s.transaction_id AS seed_id, 1 AS hop, s.transaction_id AS frontier_id, source_transaction_id AS context_id, c.t_us AS context_us FROM ev s JOIN e ON e.target_transaction_id = s.transaction_id JOIN ev c ON c.transaction_id = source_transaction_id WHERE s.label = 1 AND c.t_us < s.t_us QUALIFY row_number() OVER (PARTITION BY s.transaction_id ORDER BY md5('7|' || s.transaction_id || '|' || s.transaction_id || '|' || source_transaction_id), source_transaction_id) <= 3",
    "recent_neighbors": with_(EVENTS) + "SELECT * FROM (SELECT account, neighbor, event_id, event_us, row_number() OVER (PARTITION BY account ORDER BY event_us DESC, event_id DESC, neighbor DESC) AS rank FROM (SELECT source AS account, target AS neighbor, seq AS event_id, t_us AS event_us FROM ev UNION ALL SELECT target, source, seq, t_us FROM ev)) WHERE rank <= 5",
    "timestamp_groups": with_(ITEMS) + "SELECT row_number() OVER (ORDER BY t_us) - 1 AS group_id, t_us, count(*) AS n, true AS pure FROM it GROUP BY t_us",
    "mean_messages": with_(EVENTS, event_hops(4)) + "SELECT target_id, round(avg(ln(1 + abs(amount))), 6) AS mean_message FROM h1 JOIN ev ON ev.seq = event_id GROUP BY target_id",
    "endpoint_means": with_(ITEMS) + "SELECT t_us, account, round(avg(amount), 6) AS mean_value, count(*) AS n FROM (SELECT t_us, source AS account, amount FROM it UNION ALL SELECT t_us, target, amount FROM it) GROUP BY ALL",
    "streaming_flows": with_(EVENTS) + "SELECT t_us - t_us % 86400000000 AS window_us, account, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(1 - o) AS BIGINT) AS n_in, round(coalesce(sum(amount) FILTER (o = 1), 0), 6) AS amount_out, round(coalesce(sum(amount) FILTER (o = 0), 0), 6) AS amount_in FROM (SELECT t_us, source AS account, 1 AS o, amount FROM ev UNION ALL SELECT t_us, target, 0, amount FROM ev) GROUP BY ALL",
}
