"""DuckDB SQL with the same results as the registered queries, written from the definitions rather than from the plans."""

from __future__ import annotations

from statewalk.plans import roles
from statewalk.plans.queries import PERMUTATIONS


def _case(column: str, states: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(states)) + " END"


def _seq(table: str, sid: str, order: str, state: str, states: list[str]) -> str:
    return f"q AS (SELECT {sid} AS sid, row_number() OVER (PARTITION BY {sid} ORDER BY {order}) - 1 AS t, {_case(state, states)} AS s FROM {table} WHERE {state} IN ({', '.join(repr(x) for x in states)}))"


EVENTS = _seq("events", "user_id", "ts, event_id", "event_type", roles.EVENT_STATES)
ORDERS = _seq("orders", "o_custkey", "o_orderdate, o_orderkey", "o_orderstatus", roles.ORDER_STATES)
TURNS = _seq("conversations", "conv_id", "turn", "role", roles.ROLE_STATES)
STEP = "OVER (PARTITION BY sid ORDER BY t)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _grid(k: int) -> str:
    return f"sids AS (SELECT sid, count(*) AS steps FROM q GROUP BY sid), st AS (SELECT CAST(unnest(range({k})) AS BIGINT) AS s), grid AS (SELECT sid, steps, s FROM sids CROSS JOIN st)"


def _occ(k: int) -> str:
    return f"{_grid(k)}, occ AS (SELECT g.sid, g.s, count(q.t) AS n, count(q.t) / greatest(g.steps, 1) AS fo FROM grid g LEFT JOIN q ON q.sid = g.sid AND q.s = g.s GROUP BY g.sid, g.s, g.steps)"


RUNS = "isl AS (SELECT sid, s, t, t - row_number() OVER (PARTITION BY sid, s ORDER BY t) AS i FROM q), run AS (SELECT sid, s, min(t) AS t0, count(*) AS length FROM isl GROUP BY sid, s, i), gap AS (SELECT *, t0 - lag(t0) OVER (PARTITION BY sid, s ORDER BY t0) AS gap FROM run)"
DWELL = "dw AS (SELECT g.sid, g.s, coalesce(avg(length), 0) AS dt_mean, coalesce(quantile_cont(length, 0.5), 0) AS dt_median, coalesce(var_samp(length), 0) AS dt_var, count(length) AS n_visits, coalesce(avg(gap), 0) AS iv_mean FROM grid g LEFT JOIN gap r ON r.sid = g.sid AND r.s = g.s GROUP BY g.sid, g.s)"
PAIRS = f"pr AS (SELECT sid, s AS a, lead(s) {STEP} AS b FROM q)"
SWITCH = "sw AS (SELECT g.sid, g.s, coalesce(sum(CASE WHEN p.a <> p.b AND p.a = g.s THEN 1 ELSE 0 END + CASE WHEN p.a <> p.b AND p.b = g.s THEN 1 ELSE 0 END), 0) / greatest(g.steps - 1, 1) AS sr_state FROM grid g LEFT JOIN pr p ON p.sid = g.sid AND p.b IS NOT NULL GROUP BY g.sid, g.s, g.steps)"


def _trans(k: int) -> str:
    return f"{_grid(k)}, {PAIRS}, cnt AS (SELECT sid, a, b, count(*) AS n FROM pr WHERE b IS NOT NULL GROUP BY sid, a, b), tr AS (SELECT g.sid, g.s AS from_s, h.s AS to_s, coalesce(c.n, 0) AS n FROM grid g CROSS JOIN st h LEFT JOIN cnt c ON c.sid = g.sid AND c.a = g.s AND c.b = h.s), pb AS (SELECT *, (n + 1) / (sum(n) OVER (PARTITION BY sid, from_s) + {k}) AS p FROM tr), en AS (SELECT sid, from_s AS s, sum(-greatest(p, 1e-12) * log2(greatest(p, 1e-12))) AS h FROM pb GROUP BY sid, from_s)"


def _k3() -> str:
    cells = ", ".join(f"max(CASE WHEN from_s = {i} AND to_s = {j} THEN p END) AS p{i}{j}" for i in range(3) for j in range(3))
    w = [f"(1 - p{b}{b}) * (1 - p{d}{d}) - p{b}{d} * p{d}{b}" for b, d in ((1, 2), (0, 2), (0, 1))]
    return f"{_trans(3)}, m AS (SELECT sid, {cells} FROM pb GROUP BY sid), w AS (SELECT sid, {', '.join(f'{x} AS w{i}' for i, x in enumerate(w))} FROM m), pi AS (" + " UNION ALL ".join(f"SELECT sid, CAST({i} AS BIGINT) AS s, w{i} / (w0 + w1 + w2) AS pi FROM w" for i in range(3)) + ")"


GAMMA = (
    "w AS (SELECT l_suppkey AS sid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS t, l_quantity AS a, l_discount * CAST(100 AS DOUBLE) + 1 AS b, l_tax * CAST(100 AS DOUBLE) + 1 AS c, l_extendedprice AS price, l_quantity AS quantity FROM lineitem), "
    "gm AS (SELECT sid, t, a / (a + b + c) AS g0, b / (a + b + c) AS g1, c / (a + b + c) AS g2, price, quantity FROM w)"
)
NEXT = "nx AS (SELECT *, " + ", ".join(f"lead(g{i}) {STEP} AS h{i}" for i in range(3)) + " FROM gm)"
COUNTS = NEXT + ", ct AS (SELECT sid, count(*) AS steps, " + ", ".join(f"sum(g{i}) AS m{i}, min_by(g{i}, t) AS f{i}" for i in range(3)) + ", " + ", ".join(f"coalesce(sum(g{i} * h{j}), 0) AS c{i}{j}" for i in range(3) for j in range(3)) + " FROM nx GROUP BY sid)"
ROWS = [f"(c{i}0 + c{i}1 + c{i}2)" for i in range(3)]
SOFT = (
    COUNTS + ", lg AS (" + " UNION ALL ".join(f"SELECT sid, steps, CAST({s} AS BIGINT) AS s, m{s} AS mass, f{s} AS first, {ROWS[s]} AS row_sum, (c0{s} + c1{s} + c2{s}) AS col_sum, c{s}{s} AS stay FROM ct" for s in range(3)) + "), "
    "sm AS (SELECT sid, s, CASE WHEN mass >= 1 THEN mass / steps ELSE 0 END AS fo, mass >= 1 AS present, CASE WHEN mass >= 1 AND row_sum > 1e-6 THEN 1 / (1 - least(greatest(stay / row_sum, 0), 1 - 1e-9)) END AS dt_mean, CASE WHEN mass >= 1 AND row_sum > 1e-6 THEN first + col_sum - stay ELSE 0 END AS n_visits, CASE WHEN mass >= 1 AND row_sum > 1e-6 THEN (col_sum - stay + row_sum - stay) / greatest(steps - 1, 1) ELSE 0 END AS sr_state FROM lg)"
)


def _bits(p: str) -> str:
    return f"(-greatest({p}, 1e-12) * log2(greatest({p}, 1e-12)))"


def _entropy(ps: list[str]) -> str:
    q = [f"greatest({p}, 1e-12)" for p in ps]
    total = "(" + " + ".join(q) + ")"
    return "(" + " + ".join(f"-({x} / {total}) * log2({x} / {total})" for x in q) + ")"


G = ["g0", "g1", "g2"]
MAX = "greatest(g0, g1, g2)"
FEATURES = "ft AS (SELECT vec_id AS sid, CAST(label AS BIGINT) AS s, unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM embeddings), pt AS (SELECT s, p, avg(CAST(x AS DOUBLE)) AS mean, count(*) AS n FROM ft GROUP BY s, p)"
CORR = FEATURES + ", pc AS (SELECT a.s AS s_i, b.s AS s_j, CASE WHEN stddev_pop(a.mean) > 0 AND stddev_pop(b.mean) > 0 THEN least(greatest(corr(a.mean, b.mean), -1), 1) END AS corr FROM pt a JOIN pt b ON a.p = b.p AND a.s < b.s GROUP BY a.s, b.s)"
PARCELS = "pa AS (SELECT l_suppkey AS sid, CASE l_returnflag WHEN 'A' THEN CAST(0 AS BIGINT) WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS s, p_brand AS p, avg(l_extendedprice) AS value, CASE WHEN l_suppkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"
COV = "cv AS (SELECT c_custkey AS sid, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, c_mktsegment AS age, CAST(c_nationkey AS DOUBLE) AS fd, c_acctbal AS y FROM customer)"
BLOCKS = f"bl AS (SELECT o_custkey AS sid, {_case('o_orderstatus', roles.ORDER_STATES)} AS s, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2), cb AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS c FROM bl) WHERE c = 3)"


def _dealt(source: str, by: str = "", tag: str = "") -> str:
    """dl (with the tag): the rows of source (by, sid, grp, ...) under each permutation, grp as dealt. The bijection of the places is written out
    round by round; numbers that aren't places go through it again."""
    from statewalk.operators.permutations import PRIME, constants

    def through(rows: str) -> str:
        out = f"SELECT *, x_ // b AS _l, x_ % b AS _r FROM ({rows})"
        for h, (p, q, c) in enumerate(constants("42")):
            key = f"(SELECT *, (perm * {p} + {q}) % {PRIME} AS v FROM ({out}))"
            to, of, size = ("_l", "_r", "a") if h % 2 == 0 else ("_r", "_l", "b")
            w = f"(SELECT *, ({of} + (v * v % {PRIME}) * (v + {c}) % {PRIME}) % {PRIME} AS w FROM {key})"
            out = f"SELECT * EXCLUDE (v, w) REPLACE (({to} + (w * w % {PRIME}) * (w + {c}) % {PRIME}) % {size} AS {to}) FROM {w}"
        return f"SELECT * EXCLUDE (_l, _r) REPLACE (_l * b + _r AS x_) FROM ({out})"

    own = f"PARTITION BY {by}" if by else ""
    same = "".join(f" AND v.{c} IS NOT DISTINCT FROM l.{c}" for c in by.split(", ") if c)
    return (
        f"pl{tag} AS (SELECT *, row_number() OVER ({own} ORDER BY grp NULLS FIRST, sid) - 1 AS place, count(*) OVER ({own}) AS n FROM {source}), "
        f"st{tag} AS (SELECT *, place AS x_, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT *, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a FROM pl{tag} CROSS JOIN (SELECT unnest(range({PERMUTATIONS + 1})) AS perm))), "
        f"wk{tag} AS ({through(f'SELECT * FROM st{tag} WHERE perm > 0')} UNION ALL {through(f'SELECT * FROM wk{tag} WHERE x_ >= n')}), "
        f"dl{tag} AS (SELECT v.* REPLACE (l.grp AS grp) FROM (SELECT * FROM wk{tag} WHERE x_ < n UNION ALL SELECT * FROM st{tag} WHERE perm = 0) v JOIN pl{tag} l ON v.x_ = l.place{same})"
    )


def _permuted(grp: str) -> str:
    return f"{COV}, src AS (SELECT sid, y, {grp} AS grp FROM cv), {_dealt('src')}"


PVALUE = f"SELECT {r6('o.stat')} AS stat, {r6(f'(sum(CASE WHEN s.stat >= o.stat * (1 - 1e-9) THEN 1 ELSE 0 END) + 1) / (count(*) + 1)')} AS p_perm, count(*) AS n_perm FROM stats s CROSS JOIN (SELECT stat FROM stats WHERE perm = 0) o WHERE s.perm > 0 GROUP BY o.stat"
ETA = "(SELECT perm, avg(y) AS grand, sum((y - mu) * (y - mu)) AS sst FROM (SELECT *, avg(y) OVER (PARTITION BY perm) AS mu FROM dl) GROUP BY perm)"


def _rm(source: str, by: str) -> str:
    key, on = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return (
        f"gx AS (SELECT *, avg(y) OVER ({on}) AS mu FROM {source}), tot AS (SELECT {key}sum((y - mu) * (y - mu)) AS sst, count(DISTINCT sid) AS n FROM gx {group}), "
        f"su AS (SELECT {key}sum(c * (m - mu) * (m - mu)) AS ss FROM (SELECT {key}sid, count(*) AS c, avg(y) AS m, min(mu) AS mu FROM gx GROUP BY {key}sid) {group}), "
        f"ss AS (SELECT {key}sum(c * (m - mu) * (m - mu)) AS sa FROM (SELECT {key}s, count(*) AS c, avg(y) AS m, min(mu) AS mu FROM gx GROUP BY {key}s) {group}), "
        f"ff AS (SELECT {key}n, (sa / 2) / ((sst - ss - sa) / (n * 3 - n - 3)) AS f, sa / (sst - ss) AS eta FROM tot JOIN su {join} JOIN ss {join})"
    )


def _em_steps() -> str:
    """Two iterations of expectation and maximisation, written out: scaled forward and backward recursions, sums, new figures."""
    from statewalk.plans.queries import FEW_ITERATIONS

    (a, b), (stay0, stay1), (m0, m1) = roles.START, roles.STAY, roles.LEVELS
    parts = [
        "w AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n, (value - avg(value) OVER (PARTITION BY user_id)) / CASE WHEN stddev_samp(value) OVER (PARTITION BY user_id) > 0 THEN stddev_samp(value) OVER (PARTITION BY user_id) ELSE 1 END AS y FROM events)",
        f"p0 AS MATERIALIZED (SELECT CAST({a} AS DOUBLE) AS st, CAST({stay0} AS DOUBLE) AS s0, CAST({stay1} AS DOUBLE) AS s1, CAST({m0} AS DOUBLE) AS l0, CAST({m1} AS DOUBLE) AS l1, CAST(1 AS DOUBLE) AS v0, CAST(1 AS DOUBLE) AS v1)",
    ]
    for i in range(FEW_ITERATIONS + 1):
        density = ", ".join(f"exp(-0.5 * ((y - l{s}) * (y - l{s}) / v{s} + ln(2 * pi() * v{s}))) AS e{s}" for s in (0, 1))
        to = [f"(a0 * {x} + a1 * {y})" for x, y in (("s0", "(1 - s1)"), ("(1 - s0)", "s1"))]
        parts += [
            f"e{i} AS MATERIALIZED (SELECT sid, t, n, y, st, s0, s1, {density} FROM w CROSS JOIN p{i})",
            f"f{i} AS (SELECT sid, t, st * e0 / (st * e0 + (1 - st) * e1) AS a0, (1 - st) * e1 / (st * e0 + (1 - st) * e1) AS a1, ln(st * e0 + (1 - st) * e1) AS c FROM e{i} WHERE t = 0 UNION ALL SELECT sid, t, x0 / (x0 + x1), x1 / (x0 + x1), ln(x0 + x1) FROM (SELECT e.sid, e.t, {to[0]} * e0 AS x0, {to[1]} * e1 AS x1 FROM f{i} f JOIN e{i} e ON e.sid = f.sid AND e.t = f.t + 1))",
            f"b{i} AS (SELECT sid, t, CAST(0.5 AS DOUBLE) AS b0, CAST(0.5 AS DOUBLE) AS b1 FROM e{i} WHERE t = n - 1 UNION ALL SELECT sid, t, x0 / (x0 + x1), x1 / (x0 + x1) FROM (SELECT b.sid, b.t - 1 AS t, s0 * e0 * b0 + (1 - s0) * e1 * b1 AS x0, (1 - s1) * e0 * b0 + s1 * e1 * b1 AS x1 FROM b{i} b JOIN e{i} e ON e.sid = b.sid AND e.t = b.t WHERE b.t > 0))",
            f"g{i} AS (SELECT sid, t, y, a0 * b0 / (a0 * b0 + a1 * b1) AS g0, a1 * b1 / (a0 * b0 + a1 * b1) AS g1, c FROM f{i} JOIN b{i} USING (sid, t) JOIN e{i} USING (sid, t))",
            f"x{i} AS (SELECT sum(x00 / (x00 + x01 + x10 + x11)) AS x00, sum(x01 / (x00 + x01 + x10 + x11)) AS x01, sum(x10 / (x00 + x01 + x10 + x11)) AS x10, sum(x11 / (x00 + x01 + x10 + x11)) AS x11 FROM (SELECT a0 * s0 * e0 * b0 AS x00, a0 * (1 - s0) * e1 * b1 AS x01, a1 * (1 - s1) * e0 * b0 AS x10, a1 * s1 * e1 * b1 AS x11 FROM f{i} f JOIN e{i} e ON e.sid = f.sid AND e.t = f.t + 1 JOIN b{i} b ON b.sid = e.sid AND b.t = e.t))",
            f"m{i} AS (SELECT sum(c) AS ll, sum(CASE WHEN t = 0 THEN g0 ELSE 0 END) / sum(CASE WHEN t = 0 THEN g0 + g1 ELSE 0 END) AS st, sum(g0) AS n0, sum(g1) AS n1, sum(g0 * y) AS y0, sum(g1 * y) AS y1, sum(g0 * y * y) AS q0, sum(g1 * y * y) AS q1 FROM g{i})",
            f"p{i + 1} AS MATERIALIZED (SELECT st, x00 / (x00 + x01) AS s0, x11 / (x10 + x11) AS s1, l0, l1, greatest((q0 - 2 * l0 * y0 + l0 * l0 * n0) / n0, 1e-6) AS v0, greatest((q1 - 2 * l1 * y1 + l1 * l1 * n1) / n1, 1e-6) AS v1 FROM (SELECT *, y0 / (n0 + 1e-5) AS l0, y1 / (n1 + 1e-5) AS l1 FROM m{i}) CROSS JOIN x{i})",
        ]
    names = dict(loglik="ll", start0="p.st", stay0="s0", stay1="s1", level0="l0", level1="l1", var0="v0", var1="v1")
    rows = [f"SELECT CAST({i} AS BIGINT) AS step, {', '.join(f'{r6(x)} AS {name}' for name, x in names.items())} FROM p{i} p CROSS JOIN m{i} m" for i in range(FEW_ITERATIONS + 1)]
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(rows)}"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    ev, od = f"WITH {EVENTS}, ", f"WITH {ORDERS}, "
    out["seq_occupancy"] = f"{ev}{_occ(5)} SELECT sid, s, n, {r6('fo')} AS fo FROM occ"
    out["seq_occupancy_describe"] = f"{ev}{_occ(5)} SELECT s, count(*) AS n, {r6('avg(fo)')} AS mean, {r6('stddev_samp(fo)')} AS std, {r6('min(fo)')} AS least, {r6('quantile_cont(fo, 0.25)')} AS q25, {r6('quantile_cont(fo, 0.5)')} AS q50, {r6('quantile_cont(fo, 0.75)')} AS q75, {r6('max(fo)')} AS most FROM occ GROUP BY s"
    dwell = f"{_grid(5)}, {RUNS}, {DWELL}"
    out["seq_dwell"] = f"{ev}{dwell} SELECT sid, s, {r6('dt_mean')} AS dt_mean, {r6('dt_median')} AS dt_median, {r6('dt_var')} AS dt_var FROM dw"
    out["seq_intervisit"] = f"{ev}{dwell} SELECT sid, s, n_visits, {r6('iv_mean')} AS iv_mean FROM dw"
    out["seq_runs"] = f"{ev}{RUNS} SELECT sid, CAST(s AS BIGINT) AS s, t0, length FROM run"
    changed = f"ch AS (SELECT sid, CASE WHEN s <> lag(s) {STEP} THEN 1 ELSE 0 END AS c FROM q), sg AS (SELECT sid, count(*) AS steps, CAST(sum(c) AS BIGINT) AS switches, sum(c) / greatest(count(*) - 1, 1) AS sr FROM ch GROUP BY sid)"
    out["seq_switch_global"] = f"{ev}{changed} SELECT sid, steps, switches, {r6('sr')} AS sr_global FROM sg"
    out["seq_switch_state"] = f"{ev}{_grid(5)}, {PAIRS}, {SWITCH} SELECT sid, s, {r6('sr_state')} AS sr_state FROM sw"
    out["seq_transition_counts"] = f"{ev}{_trans(5)} SELECT sid, from_s, to_s, n FROM tr"
    out["seq_transition_probs"] = f"{ev}{_trans(5)} SELECT sid, from_s, to_s, {r6('p')} AS p FROM pb"
    out["seq_row_entropy"] = f"{ev}{_trans(5)} SELECT sid, s, {r6('h')} AS row_entropy_bits FROM en"
    out["seq_self_transition"] = f"{ev}{_trans(5)} SELECT sid, from_s AS s, {r6('p')} AS self_transition FROM pb WHERE from_s = to_s"
    occ3 = "occ AS (SELECT g.sid, g.s, count(q.t) / greatest(g.steps, 1) AS fo FROM grid g LEFT JOIN q ON q.sid = g.sid AND q.s = g.s GROUP BY g.sid, g.s, g.steps)"
    out["seq_state_metrics"] = (
        f"{od}{_trans(3)}, {occ3}, {RUNS}, {DWELL}, {SWITCH} SELECT o.sid, o.s, {r6('o.fo')} AS fo, {r6('d.dt_mean')} AS dt_mean, {r6('d.dt_median')} AS dt_median, {r6('d.dt_var')} AS dt_var, d.n_visits, {r6('d.iv_mean')} AS iv_mean, {r6('w.sr_state')} AS sr_state, {r6('e.h')} AS row_entropy_bits, {r6('p.p')} AS self_transition "
        "FROM occ o JOIN dw d USING (sid, s) JOIN sw w USING (sid, s) JOIN en e USING (sid, s) JOIN pb p ON p.sid = o.sid AND p.from_s = o.s AND p.to_s = o.s"
    )
    out["seq_lzc"] = (
        f"WITH RECURSIVE {TURNS}, lg AS (SELECT sid, t, s, lag(s) {STEP} AS p FROM q), sig AS (SELECT sid, coalesce(string_agg(CASE WHEN s <> p THEN '1' ELSE '0' END, '' ORDER BY t) FILTER (WHERE p IS NOT NULL), '') AS b FROM lg GROUP BY sid), "
        "walk AS (SELECT sid, b, length(b) AS n, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS l, CAST(1 AS BIGINT) AS c, FALSE AS done FROM sig WHERE length(b) > 0 UNION ALL "
        "SELECT sid, b, n, CASE WHEN i + k > n OR hit THEN i ELSE l + k - 1 END, CASE WHEN i + k > n THEN k WHEN hit THEN k + 1 ELSE 1 END, CASE WHEN i + k > n OR hit THEN l ELSE l + k END, CASE WHEN i + k <= n AND hit THEN c ELSE c + 1 END, i + k > n OR (NOT hit AND l + k > n) "
        "FROM (SELECT *, position(substr(b, CAST(i + 1 AS BIGINT), k) IN substr(b, 1, CAST(l - 1 AS BIGINT))) > 0 AS hit FROM walk WHERE NOT done) x) "
        f"SELECT g.sid, {r6('CASE WHEN w.sid IS NULL THEN 0 WHEN w.n > 1 THEN w.c / (w.n / log2(w.n)) ELSE w.c END')} AS lzc_switches FROM sig g LEFT JOIN walk w ON w.sid = g.sid AND w.done"
    )
    out["chain_stationary_k3"] = f"{od}{_k3()} SELECT sid, s, {r6('pi')} AS pi FROM pi"
    det = "p00 * (p11 * p22 - p12 * p21) - p01 * (p10 * p22 - p12 * p20) + p02 * (p10 * p21 - p11 * p20)"
    out["chain_gap_k3"] = f"{od}{_k3()}, ei AS (SELECT sid, p00 + p11 + p22 - 1 AS b, {det} AS d FROM m) SELECT sid, {r6('1 - greatest(abs((b + sqrt(greatest(b * b - 4 * d, 0))) / 2), abs((b - sqrt(greatest(b * b - 4 * d, 0))) / 2))')} AS spectral_gap FROM ei"
    out["chain_entropy_rate_k3"] = f"{od}{_k3()} SELECT sid, {r6('sum(pi * h)')} AS entropy_rate_bits FROM pi JOIN en USING (sid, s) GROUP BY sid"
    z = "(x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w > 0 THEN stddev_samp(x) OVER w ELSE 1 END"
    out["ts_zscore"] = f"SELECT user_id AS sid, event_id, {r6(z.replace('x', 'value').replace('avalueg', 'avg'))} AS z FROM events WINDOW w AS (PARTITION BY user_id)"
    out["map_zscore"] = f"WITH {FEATURES} SELECT s, p, {r6(z.replace('(x', '(mean'))} AS z FROM (SELECT *, mean AS x FROM pt) WINDOW w AS (PARTITION BY s)"
    out["state_mean_patterns"] = f"WITH {FEATURES} SELECT s, p, {r6('mean')} AS mean FROM pt"
    long = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS s, CAST({j} AS BIGINT) AS p, g{i} AS g, {x} AS x FROM gm" for i in range(3) for j, x in enumerate(("price", "quantity")))
    out["state_weighted_mean_var"] = f"WITH {GAMMA}, lo AS ({long}), mv AS (SELECT s, p, sum(g * x) / sum(g) AS mean, greatest(sum(g * x * x) / sum(g) - (sum(g * x) / sum(g)) * (sum(g * x) / sum(g)), 1e-6) AS var FROM lo GROUP BY s, p) SELECT s, p, round(mean, 4) + 0.0 AS mean, {r6('var / greatest(mean * mean, 1)')} AS var_over_mean_sq FROM mv"
    out["pattern_correlations"] = f"WITH {CORR} SELECT s_i, s_j, {r6('corr')} AS corr FROM pc"
    out["clone_pairs"] = f"WITH {CORR} SELECT s_i, s_j, {r6('corr')} AS corr FROM pc WHERE corr >= 0.05"
    out["clone_max_corr"] = f"WITH {CORR} SELECT {r6('max(corr)')} AS max_corr, count(corr) AS n_pairs FROM pc"
    out["beta_maps_hard"] = f"WITH {FEATURES} SELECT s, p, {r6('mean - sum(mean * n) OVER w / sum(n) OVER w')} AS beta FROM pt WINDOW w AS (PARTITION BY p)"
    out["soft_transitions"] = f"WITH {GAMMA}, {COUNTS} " + " UNION ALL ".join(f"SELECT sid, CAST({i} AS BIGINT) AS from_s, CAST({j} AS BIGINT) AS to_s, {r6(f'c{i}{j}')} AS c FROM ct" for i in range(3) for j in range(3))
    out["soft_state_metrics"] = f"WITH {GAMMA}, {SOFT} SELECT sid, s, {r6('fo')} AS fo, present, {r6('dt_mean')} AS dt_mean, {r6('n_visits')} AS n_visits, {r6('sr_state')} AS sr_state FROM sm"
    junk = "ju AS (SELECT s, quantile_cont(fo, 0.5) AS fo_median, avg(fo) AS fo_mean, quantile_cont(fo, 0.05) AS fo_q05, avg(CASE WHEN present THEN 1 ELSE 0 END) AS presence_frac, quantile_cont(dt_mean, 0.5) AS dt_median, avg(dt_mean) AS dt_mean, quantile_cont(n_visits, 0.5) AS n_visits_median, avg(n_visits) AS n_visits_mean, avg(sr_state) AS sr_state_mean FROM sm GROUP BY s)"
    names = ("fo_median", "fo_mean", "fo_q05", "presence_frac", "dt_median", "dt_mean", "n_visits_median", "n_visits_mean", "sr_state_mean")
    out["junk_table"] = f"WITH {GAMMA}, {SOFT}, {junk} SELECT s, {', '.join(f'{r6(x)} AS {x}' for x in names)}, fo_median < 0.01 AS flag_low_fo, coalesce(dt_median < 2, FALSE) AS flag_short_dt, presence_frac < 0.5 AS flag_low_presence, fo_median < 0.01 OR coalesce(dt_median < 2, FALSE) OR presence_frac < 0.5 AS junk_state FROM ju"
    rate = " + ".join(f"m{i} / (m0 + m1 + m2) * CASE WHEN {ROWS[i]} >= 1 THEN {' + '.join(_bits(f'(c{i}{j} / {ROWS[i]})') for j in range(3))} ELSE 0 END" for i in range(3))
    stay = [f"CASE WHEN {ROWS[i]} >= 1 THEN c{i}{i} / {ROWS[i]} END" for i in range(3)]
    mean = "(" + " + ".join(f"coalesce({x}, 0)" for x in stay) + ") / nullif(" + " + ".join(f"CASE WHEN {ROWS[i]} >= 1 THEN 1 ELSE 0 END" for i in range(3)) + ", 0)"
    out["soft_randomness"] = f"WITH {GAMMA}, {COUNTS} SELECT sid, {r6(_entropy(['m0 / steps', 'm1 / steps', 'm2 / steps']))} AS occ_entropy_bits, {r6(rate)} AS entropy_rate_bits, {r6(mean)} AS mean_self_transition FROM ct"
    p = {(i, j): f"(c{i}{j} / CASE WHEN {ROWS[i]} >= 1 THEN {ROWS[i]} END)" for i in range(3) for j in range(3)}
    up = [(0, 1), (0, 2), (1, 2)]
    apart, joint = ("(" + " + ".join(f"abs({p[i, j]} {op} {p[j, i]})" for i, j in up) + ") / 3" for op in "-+")
    out["asymmetry"] = f"WITH {GAMMA}, {COUNTS} SELECT sid, {r6(apart)} AS asym_raw, {r6(f'({apart}) / ({joint} + 1e-12)')} AS asym_norm FROM ct"
    out["soft_switch_rate"] = f"WITH {GAMMA}, {NEXT} SELECT sid, {r6('avg(1 - (g0 * h0 + g1 * h1 + g2 * h2))')} AS switch_rate_soft FROM nx GROUP BY sid"
    out["indecision_subject"] = f"WITH {GAMMA}, x AS (SELECT sid, {_entropy(G)} AS h, {MAX} AS m FROM gm) SELECT sid, count(*) AS steps, {r6('avg(h)')} AS entropy_mean, {r6('quantile_cont(h, 0.5)')} AS entropy_median, {r6('avg(m)')} AS max_mean, {r6('quantile_cont(m, 0.5)')} AS max_median, {r6('avg(CASE WHEN m >= 0.8 THEN 1 ELSE 0 END)')} AS frac_dominant, {r6('avg(CASE WHEN m < 0.5 THEN 1 ELSE 0 END)')} AS frac_ambiguous FROM x GROUP BY sid"
    out["posterior_sharpness"] = f"WITH {GAMMA}, x AS (SELECT {MAX} AS m FROM gm) SELECT count(*) AS steps, {r6('quantile_cont(m, 0.5)')} AS median, {r6('quantile_cont(m, 0.25)')} AS p25, {r6('quantile_cont(m, 0.75)')} AS p75, {r6('min(m)')} AS least, {r6('max(m)')} AS most FROM x"
    out["posterior_hist"] = f"WITH {GAMMA}, x AS (SELECT CAST(least(floor({MAX} * 20), 19) AS BIGINT) AS b, count(*) AS n FROM gm GROUP BY 1), bins AS (SELECT unnest(range(20)) AS b) SELECT {r6('bins.b / 20')} AS bin_left, {r6('(bins.b + 1) / 20')} AS bin_right, coalesce(n, 0) AS n FROM bins LEFT JOIN x ON x.b = bins.b"
    parts = "pt AS (SELECT sid, CAST(floor(t * 4 / steps) AS BIGINT) AS part, avg(g0) AS g0, avg(g1) AS g1, avg(g2) AS g2 FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS steps FROM gm) GROUP BY 1, 2), lo AS (" + " UNION ALL ".join(f"SELECT sid, part, {i} AS s, g{i} AS x FROM pt" for i in range(3)) + "), rr AS (SELECT a.sid, a.part AS p, b.part AS q, CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN corr(a.x, b.x) END AS r FROM lo a JOIN lo b ON a.sid = b.sid AND a.s = b.s AND a.part < b.part GROUP BY 1, 2, 3)"
    out["reliability_runs"] = f"WITH {GAMMA}, {parts} SELECT sid, round(avg(r), 5) + 0.0 AS fo_gamma_r FROM rr GROUP BY sid"
    out["network_fingerprint"] = f"WITH {FEATURES}, nm AS (SELECT DISTINCT p, lower('area_' || CASE p % 4 WHEN 0 THEN 'Vis' WHEN 1 THEN 'SomMot' WHEN 2 THEN 'Cont' ELSE 'Default' END || '_' || p) AS name FROM pt), tk(network, token) AS (VALUES ('visual', 'vis'), ('motor', 'sommot'), ('motor', 'motor'), ('control', 'cont'), ('default', 'default')), hit AS (SELECT DISTINCT p, network FROM nm JOIN tk ON contains(name, token)) SELECT s, network, {r6('avg(mean)')} AS value FROM pt JOIN hit USING (p) GROUP BY s, network"
    sides = ("CASE WHEN stddev_pop(sr) > 0 AND stddev_pop({0}) > 0 THEN corr(sr, {0}) END".format(c) for c in ("fd", "y"))
    out["nuisance_corr"] = f"{od}{changed}, {COV}, x AS (SELECT sg.sr, cv.fd, cv.y FROM sg LEFT JOIN cv ON cv.sid = sg.sid) SELECT {r6(next(sides))} AS r_sr_fd, {r6(next(sides))} AS r_sr_y, count(fd) AS n FROM x"
    out["group_mean_sd"] = f"WITH {PARCELS} SELECT s, p, count(value) AS n, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS sd FROM pa GROUP BY s, p"
    by_sex = ", ".join(r6("avg(CASE WHEN sex = '%s' THEN value END)" % g) + f" AS mean_{g.lower()}" for g in "MF")
    out["parcel_summary"] = f"WITH {PARCELS} SELECT s, p, count(value) AS n, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS sd, {by_sex} FROM pa GROUP BY s, p"
    out["parcel_wide"] = f"WITH {PARCELS} SELECT p, " + ", ".join(f"{r6(f'avg(CASE WHEN s = {i} THEN value END)')} AS state{i}" for i in range(3)) + " FROM pa GROUP BY p"
    for name, f in (("parcellate_mean", "avg(l_quantity)"), ("parcellate_median", "quantile_cont(l_quantity, 0.5)")):
        out[name] = f"SELECT l_suppkey AS sid, CAST(l_linenumber AS BIGINT) AS t, p_brand AS label, {r6(f)} AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"
    out["paint_labels"] = f"WITH {PARCELS}, v AS (SELECT s, p AS label, avg(value) AS value FROM pa GROUP BY 1, 2), st AS (SELECT DISTINCT s FROM v) SELECT p_partkey AS elem, st.s, {r6('coalesce(v.value, 0)')} AS value FROM part CROSS JOIN st LEFT JOIN v ON v.label = part.p_brand AND v.s = st.s"
    out["covariate_normalize"] = (
        "WITH x AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS uid, CASE c_custkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN ' Female ' WHEN 2 THEN '1' WHEN 3 THEN '0.0' WHEN 4 THEN '' ELSE 'x' END AS sex, c_mktsegment AS age_group, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS fd FROM customer) "
        f"SELECT uid || '_run1' AS sid, uid, CASE WHEN upper(trim(sex)) IN ('M', 'MALE', '1', '1.0') THEN 'M' WHEN upper(trim(sex)) IN ('F', 'FEMALE', '0', '0.0') THEN 'F' ELSE upper(trim(sex)) END AS sex, age_group, {r6('fd')} AS fd FROM x"
    )
    out["covariate_fallback_join"] = f"WITH {COV}, s AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT 'c' || s.id || '_b' AS sid, cv.sex, {r6('CASE WHEN s.id % 7 <> 0 THEN cv.fd END')} AS fd FROM s LEFT JOIN cv ON cv.sid = s.id"
    out["preferred_file"] = "WITH f AS (SELECT 'c' || o_custkey AS sid, 'c' || o_custkey || '_' || CASE WHEN o_orderstatus = 'P' THEN 'REST' ELSE 'task' END || o_orderkey || '.ptseries' AS name FROM orders) SELECT sid, name FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN contains(lower(name), 'rest') THEN 0 ELSE 1 END, name) AS i FROM f) WHERE i = 1"
    levels = f"{COV}, lv AS (SELECT age AS level, row_number() OVER (ORDER BY min(sid), age) - 1 AS place FROM cv GROUP BY age)"
    out["one_hot_levels"] = f"WITH {levels} SELECT level, place FROM lv"
    out["design_matrix"] = f"WITH {levels} SELECT sid, CAST(1 AS DOUBLE) AS intercept, " + ", ".join(f"CAST(CASE WHEN place = {i} THEN 1 ELSE 0 END AS DOUBLE) AS age_{i}" for i in range(1, 5)) + f", {r6('CASE WHEN sex = chr(77) THEN 1 ELSE 0 END - avg(CASE WHEN sex = chr(77) THEN 1 ELSE 0 END) OVER ()')} AS sex, {r6('fd - avg(fd) OVER ()')} AS fd FROM cv JOIN lv ON lv.level = cv.age"
    out["design_mapping"] = "SELECT c_custkey AS pos, 'c' || c_custkey AS sid, k AS state, c_custkey * 3 + k AS row_key FROM customer CROSS JOIN (SELECT unnest(range(1, 4)) AS k)"
    one = "(c_custkey * 7919) % 1000003"
    listed = f"o AS (SELECT {one} AS pos, c_custkey AS sid FROM customer UNION ALL SELECT {one} + 1000003, c_custkey FROM customer WHERE c_nationkey = 0 UNION ALL SELECT {one} + 2000006, -c_custkey FROM customer WHERE c_nationkey = 0), u AS (SELECT min(pos) AS pos, sid FROM o GROUP BY sid)"
    out["stack_columns"] = f"WITH {listed} SELECT st.s AS state, row_number() OVER (PARTITION BY st.s ORDER BY pos, sid) AS col_index, sid FROM u CROSS JOIN (SELECT CAST(unnest(range(3)) AS BIGINT) AS s) st"
    out["order_join"] = f"WITH {listed}, {COV} SELECT u.sid, u.pos, cv.sex, {r6('cv.y')} AS y FROM u JOIN cv ON cv.sid = u.sid UNION ALL SELECT sid, NULL, 'absent', NULL FROM u WHERE sid NOT IN (SELECT sid FROM cv)"
    out["group_stack"] = f"WITH {PARCELS}, so AS (SELECT sid, (sid * 31) % 101 AS pos FROM (SELECT DISTINCT sid FROM pa)), co AS (SELECT sid, row_number() OVER (ORDER BY pos, sid) AS col_index FROM so) SELECT pa.s AS state, col_index, sid, p, {r6('value')} AS value FROM co JOIN pa USING (sid)"
    out["subject_level_design"] = f"WITH {COV} SELECT sid, {r6('fd')} AS fd FROM cv"
    out["map_shapes"] = f"WITH {PARCELS}, b AS (SELECT sid, count(DISTINCT s) AS states, count(DISTINCT p) AS features, count(*) AS cells FROM pa GROUP BY sid) SELECT sid, states, features FROM b WHERE states <> 3 OR features <> (SELECT min_by(features, sid) FROM b) OR cells <> states * features"
    out["alignment_check"] = (
        "WITH e AS (SELECT CAST(c_nationkey % 3 AS BIGINT) AS state, c_custkey AS pos, 'c' || c_custkey AS sid, c_acctbal FROM customer), a AS (SELECT state, pos, CASE WHEN c_acctbal < 0 THEN 'other' ELSE sid END AS sid FROM e WHERE pos IN (SELECT o_custkey FROM orders)), "
        "x AS (SELECT e.state, e.pos, e.sid AS expected_sid, a.sid AS actual_sid, CASE WHEN a.sid IS NULL THEN 'missing' WHEN a.sid <> e.sid THEN 'differs' END AS kind FROM e LEFT JOIN a ON a.state = e.state AND a.pos = e.pos) "
        "SELECT state, pos, expected_sid, actual_sid, kind FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY pos) AS i FROM x WHERE kind IS NOT NULL) WHERE i <= 10"
    )
    m, f = ("CASE WHEN sex = '%s' THEN y END" % g for g in "MF")
    out["cohen_d"] = f"WITH {COV}, g AS (SELECT age, count({m}) AS nm, count({f}) AS nf, avg({m}) AS m, avg({f}) AS f, var_samp({m}) AS vm, var_samp({f}) AS vf FROM cv GROUP BY age), d AS (SELECT *, sqrt(((nm - 1) * coalesce(vm, 0) + (nf - 1) * coalesce(vf, 0)) / greatest(nm + nf - 2, 1)) AS sd FROM g) SELECT age, {r6('CASE WHEN nm > 0 AND nf > 0 AND sd > 0 THEN (m - f) / sd ELSE 0 END')} AS d FROM d"
    out["eta_sq"] = f"WITH {COV}, x AS (SELECT *, avg(y) OVER (PARTITION BY sex) AS mu FROM cv), l AS (SELECT sex, age, count(*) AS n, avg(y) AS m, min(mu) AS mu, sum((y - mu) * (y - mu)) AS sst FROM x GROUP BY sex, age) SELECT sex, {r6('sum(n * (m - mu) * (m - mu)) / sum(sst)')} AS eta_sq FROM l GROUP BY sex"
    out["residualize"] = f"WITH {COV}, c AS (SELECT sex, regr_slope(y, fd) AS b, regr_intercept(y, fd) AS a FROM cv GROUP BY sex) SELECT sid, round(y - (a + b * fd), 4) AS r FROM cv JOIN c USING (sex)"
    out["perm_two_level"] = f"WITH RECURSIVE {_permuted('sex')}, stats AS (SELECT perm, abs(avg(CASE WHEN grp = 'M' THEN y END) - avg(CASE WHEN grp = 'F' THEN y END)) AS stat FROM dl GROUP BY perm) {PVALUE}"
    out["perm_multi_level"] = f"WITH RECURSIVE {_permuted('age')}, gm AS {ETA}, lv AS (SELECT perm, grp, count(*) AS n, avg(y) AS m FROM dl GROUP BY perm, grp), stats AS (SELECT gm.perm, sum(n * (m - grand) * (m - grand)) / min(sst) AS stat FROM gm JOIN lv ON lv.perm = gm.perm GROUP BY gm.perm) {PVALUE}"
    out["rm_state_f"] = f"WITH {BLOCKS}, {_rm('cb', '')} SELECT n AS n_sid, {r6('f')} AS f_obs, CAST(2 AS BIGINT) AS df_num, n * 3 - n - 3 AS df_den, {r6('eta')} AS partial_eta2 FROM ff"
    sub = f"{PARCELS}, sj AS (SELECT DISTINCT s, sid, sex AS grp FROM pa), {_dealt('sj', 's')}"
    mv, fv = ("CASE WHEN grp = '%s' THEN value END" % g for g in "MF")
    glm = f"ag AS (SELECT perm, s, p, count({mv}) AS nm, count({fv}) AS nf, avg({mv}) AS m, avg({fv}) AS f, var_samp({mv}) AS vm, var_samp({fv}) AS vf FROM pa JOIN dl USING (s, sid) GROUP BY perm, s, p), tt AS (SELECT perm, s, p, (m - f) / sqrt(((nm - 1) * vm + (nf - 1) * vf) / (nm + nf - 2) * (1 / nm + 1 / nf)) AS t FROM ag)"
    most = "mx AS (SELECT s, perm, max(abs(t)) AS most FROM tt WHERE perm > 0 GROUP BY s, perm)"
    fwe = f"SELECT tt.s, p, {r6('t')} AS t, CASE WHEN t IS NOT NULL THEN {r6('(sum(CASE WHEN most >= abs(t) * (1 - 1e-9) THEN 1 ELSE 0 END) + 1) / (count(*) + 1)')} END AS p_fwe FROM tt JOIN mx ON mx.s = tt.s WHERE tt.perm = 0 GROUP BY tt.s, p, t"
    out["parcel_glm_fwe"] = f"WITH RECURSIVE {sub}, {glm}, {most} {fwe}"
    flips = (
        f"{PARCELS}, ce AS (SELECT s, sid, p, value - avg(value) OVER (PARTITION BY s, sid) AS value FROM pa), pm AS (SELECT unnest(range({PERMUTATIONS + 1})) AS perm), "
        "fl AS (SELECT perm, s, sid, p, CASE WHEN perm > 0 AND substr(md5('42:' || perm || ':' || sid), 1, 1) < '8' THEN -value ELSE value END AS value FROM ce CROSS JOIN pm), "
        "ag AS (SELECT perm, s, p, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM fl GROUP BY perm, s, p), tt AS (SELECT perm, s, p, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END AS t FROM ag)"
    )
    out["parcel_sign_flip"] = f"WITH {flips}, {most} {fwe}"
    dealt = f"pm AS (SELECT unnest(range({PERMUTATIONS + 1})) AS perm), de AS (SELECT perm, sid, y, row_number() OVER (PARTITION BY perm, sid ORDER BY CASE WHEN perm > 0 THEN md5('42:' || perm || ':' || sid || ':' || s) ELSE lpad(CAST(s AS VARCHAR), 20, '0') END, s) - 1 AS s FROM cb CROSS JOIN pm)"
    out["rm_state_perm"] = f"WITH {BLOCKS}, {dealt}, {_rm('de', 'perm')}, stats AS (SELECT perm, f AS stat FROM ff) {PVALUE}"
    def inter(source: str, by: str) -> str:
        key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
        mean = f"(SELECT *, y - avg(y) OVER (PARTITION BY {key}sid) AS c FROM {source})"
        return (
            f"ce AS (SELECT {key}grp, s, count(*) AS n, sum(c) AS t, sum(c * c) AS q FROM {mean} GROUP BY {key}grp, s), "
            f"sa AS (SELECT {key}s, sum(n) AS n, sum(t) AS t, sum(q) AS q, sum(t * t / n) AS cells, count(*) AS g FROM ce GROUP BY {key}s), "
            f"ia AS (SELECT {key}sum(q) AS q, sum(cells) AS cells, sum(t * t / n) AS st, max(g) AS g, max(n) AS n FROM sa {group}), "
            f"fi AS (SELECT {key}((cells - st) / ((g - 1) * 2)) / ((q - cells) / (n * 2 - g * 3)) AS f, CAST((g - 1) * 2 AS BIGINT) AS df_num, CAST(n * 2 - g * 3 AS BIGINT) AS df_den, (cells - st) / (q - st) AS eta FROM ia)"
        )

    both = f"{BLOCKS}, {COV}, bg AS (SELECT cb.sid, cb.s, cb.y, cv.sex AS grp FROM cb JOIN cv USING (sid))"
    out["rm_interaction_f"] = f"WITH {both}, {inter('bg', '')} SELECT {r6('f')} AS f_obs, df_num, df_den, {r6('eta')} AS partial_eta2 FROM fi"
    levels_dealt = f"sj AS (SELECT DISTINCT sid, grp FROM bg), {_dealt('sj')}, dx AS (SELECT dl.perm, bg.sid, bg.s, bg.y, dl.grp FROM bg JOIN dl USING (sid))"
    out["rm_interaction_perm"] = f"WITH RECURSIVE {both}, {levels_dealt}, {inter('dx', 'perm')}, stats AS (SELECT perm, f AS stat FROM fi) {PVALUE}"
    out["bh_adjust"] = (
        "WITH x AS (SELECT p_partkey, p_brand, ((p_retailprice * CAST(7 AS DOUBLE)) % CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS m FROM x) "
        f"SELECT p_partkey, p_brand, {r6('p')} AS p, {r6('least(min(p * m / i) OVER (PARTITION BY p_brand ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)')} AS q_bh FROM r"
    )
    lags = "lg AS (SELECT user_id AS sid, event_id, value, coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS lag1, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS lag2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
    out["ar_lag_design"] = f"WITH {lags} SELECT sid, event_id, {r6('lag1')} AS lag1, {r6('lag2')} AS lag2 FROM lg"
    out["ar_emission_loglik"] = f"WITH {lags} SELECT sid, event_id, CAST(s AS BIGINT) AS s, {r6('-0.5 * ((value - (lag1 * b + 10)) * (value - (lag1 * b + 10)) / v + ln(2 * pi() * v))')} AS log_b FROM lg CROSS JOIN (VALUES (0, CAST(0.5 AS DOUBLE), CAST(100 AS DOUBLE)), (1, CAST(-0.25 AS DOUBLE), CAST(400 AS DOUBLE))) x(s, b, v)"
    (s0, s1), (t0, t1), (h0, h1) = roles.START, roles.STAY, roles.HIT

    def hit(h: float, s: str) -> str:
        return f"CASE WHEN {s} = 0 THEN CAST({h} AS DOUBLE) ELSE 1 - CAST({h} AS DOUBLE) END"

    out["hmm_forward_fixed"] = (
        f"WITH RECURSIVE {TURNS}, fw AS (SELECT sid, t, CAST({s0} AS DOUBLE) * {hit(h0, 's')} AS a, CAST({s1} AS DOUBLE) * {hit(h1, 's')} AS b FROM q WHERE t = 0 UNION ALL "
        f"SELECT q.sid, q.t, (a * CAST({t0} AS DOUBLE) + b * (1 - CAST({t1} AS DOUBLE))) * {hit(h0, 'q.s')}, (a * (1 - CAST({t0} AS DOUBLE)) + b * CAST({t1} AS DOUBLE)) * {hit(h1, 'q.s')} FROM fw JOIN q ON q.sid = fw.sid AND q.t = fw.t + 1) "
        f"SELECT sid, {r6('ln(max_by(a + b, t))')} AS loglik FROM fw GROUP BY sid"
    )
    out["segment_index"] = f"{ev}n AS (SELECT sid, count(*) AS n_tr FROM q GROUP BY sid) SELECT sid, CAST(sum(n_tr) OVER (ORDER BY sid) - n_tr AS BIGINT) AS start, CAST(sum(n_tr) OVER (ORDER BY sid) AS BIGINT) AS \"end\", n_tr FROM n"
    out["state_text"] = f"WITH {EVENTS} SELECT sid, string_agg(CAST(s AS VARCHAR), chr(10) ORDER BY t) AS value FROM q GROUP BY sid"
    out["exchange_blocks"] = "SELECT c_custkey * 3 + k AS row_key, 'c' || c_custkey AS sid, row_number() OVER (PARTITION BY k ORDER BY c_custkey) AS block FROM customer CROSS JOIN (SELECT unnest(range(1, 4)) AS k)"
    out["beta_features"] = f"WITH {FEATURES}, bm AS (SELECT s, p, mean - sum(mean * n) OVER w / sum(n) OVER w AS beta FROM pt WINDOW w AS (PARTITION BY p)) SELECT sid, s, {r6('sqrt(avg((CAST(x AS DOUBLE) - beta) * (CAST(x AS DOUBLE) - beta)))')} AS distance FROM ft JOIN bm USING (s, p) GROUP BY sid, s"
    out["used_parcels"] = f"WITH {PARCELS}, li AS (SELECT l_suppkey AS sid, l_linestatus, min(l_orderkey) AS pos FROM lineitem GROUP BY 1, 2) SELECT s, p, count(*) AS n, {r6('avg(value)')} AS mean FROM li JOIN pa USING (sid) GROUP BY s, p"
    out["unknown_states"] = "SELECT event_type AS state, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1"

    # soft regression maps: the normal equations of three states by Cramer's rule, centred by the mean probabilities
    a = {(i, j): f"a{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}

    def minor(cells: dict, b: int | None) -> str:
        """The determinant of the 3 x 3 matrix, its column b replaced by the right side."""
        c = {(i, j): f"r{i}" if j == b else cells[i, j] for i in range(3) for j in range(3)}
        return f"({c[0, 0]} * ({c[1, 1]} * {c[2, 2]} - {c[1, 2]} * {c[2, 1]}) - {c[0, 1]} * ({c[1, 0]} * {c[2, 2]} - {c[1, 2]} * {c[2, 0]}) + {c[0, 2]} * ({c[1, 0]} * {c[2, 1]} - {c[1, 1]} * {c[2, 0]}))"

    sides = " UNION ALL ".join(f"SELECT sid, CAST({p} AS BIGINT) AS p, g0, g1, g2, {x} AS y FROM gm" for p, x in enumerate(("price / 1000", "quantity")))
    sums = ", ".join([f"sum(g{i} * g{j}) AS a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(g{i} * y) AS r{i}" for i in range(3)] + [f"avg(g{i}) AS m{i}" for i in range(3)])
    solved = ", ".join(f"{minor(a, b)} / {minor(a, None)} AS b{b}" for b in range(3))
    out["beta_maps_soft"] = f"WITH {GAMMA}, lo AS ({sides}), su AS (SELECT sid, p, {sums} FROM lo GROUP BY sid, p), so AS (SELECT sid, p, m0, m1, m2, {solved} FROM su) " + " UNION ALL ".join(f"SELECT sid, CAST({i} AS BIGINT) AS s, p, {r6(f'b{i} - (m0 * b0 + m1 * b1 + m2 * b2)')} AS beta FROM so" for i in range(3))

    # three states in general and closed form
    gap = "gp AS (SELECT sid, 1 - greatest(abs((b + sqrt(greatest(b * b - 4 * d, 0))) / 2), abs((b - sqrt(greatest(b * b - 4 * d, 0))) / 2)) AS gap FROM (SELECT sid, p00 + p11 + p22 - 1 AS b, " + det + " AS d FROM m))"
    out["chain_stationary_general"] = f"{od}{_k3()}, {gap} SELECT sid, s, {r6('pi')} AS pi, {r6('gap')} AS spectral_gap FROM pi JOIN gp USING (sid)"
    lzc = "SELECT sid, b, length(b) AS n, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS l, CAST(1 AS BIGINT) AS c, FALSE AS done FROM sig WHERE length(b) > 0 UNION ALL " "SELECT sid, b, n, CASE WHEN i + k > n OR hit THEN i ELSE l + k - 1 END, CASE WHEN i + k > n THEN k WHEN hit THEN k + 1 ELSE 1 END, CASE WHEN i + k > n OR hit THEN l ELSE l + k END, CASE WHEN i + k <= n AND hit THEN c ELSE c + 1 END, i + k > n OR (NOT hit AND l + k > n) FROM (SELECT *, position(substr(b, CAST(i + 1 AS BIGINT), k) IN substr(b, 1, CAST(l - 1 AS BIGINT))) > 0 AS hit FROM walk WHERE NOT done) x"
    signal = f"lg AS (SELECT sid, t, s, lag(s) {STEP} AS p FROM q), sig AS (SELECT sid, coalesce(string_agg(CASE WHEN s <> p THEN '1' ELSE '0' END, '' ORDER BY t) FILTER (WHERE p IS NOT NULL), '') AS b FROM lg GROUP BY sid), walk AS ({lzc}), lz AS (SELECT g.sid, CASE WHEN w.sid IS NULL THEN 0 WHEN w.n > 1 THEN w.c / (w.n / log2(w.n)) ELSE w.c END AS lzc FROM sig g LEFT JOIN walk w ON w.sid = g.sid AND w.done)"
    shares = "oc AS (SELECT sid, s, count(*) AS n FROM q GROUP BY sid, s), of AS (SELECT g.sid, greatest(coalesce(o.n, 0) / g.steps, 1e-12) AS f FROM grid g LEFT JOIN oc o ON o.sid = g.sid AND o.s = g.s), oe AS (SELECT sid, sum(-(f / t) * log2(f / t)) AS h FROM (SELECT *, sum(f) OVER (PARTITION BY sid) AS t FROM of) GROUP BY sid)"
    out["seq_global_metrics"] = (
        f"WITH RECURSIVE {ORDERS}, {_k3()}, {gap}, {changed}, {shares}, {signal}, rate AS (SELECT sid, sum(pi * h) AS rate FROM pi JOIN en USING (sid, s) GROUP BY sid), stay AS (SELECT sid, avg(p) AS stay FROM pb WHERE from_s = to_s GROUP BY sid) "
        f"SELECT g.sid, {r6('sr')} AS sr_global, {r6('oe.h')} AS occ_entropy_bits, {r6('rate')} AS entropy_rate_bits, {r6('stay')} AS mean_self_transition, {r6('gap')} AS spectral_gap, {r6('lzc')} AS lzc_switches FROM sg g JOIN oe USING (sid) JOIN rate USING (sid) JOIN stay USING (sid) JOIN gp USING (sid) JOIN lz USING (sid)"
    )

    # sex and age effects with permutations by family
    def family_effects(metrics: str, key: str) -> str:
        value = f"SELECT s.{', s.'.join(key.split(', '))}, o.stat, (sum(CASE WHEN s.stat >= o.stat * (1 - 1e-9) THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS p_perm FROM %s s JOIN %s o USING ({key}) WHERE s.perm > 0 AND o.perm = 0 GROUP BY s.{', s.'.join(key.split(', '))}, o.stat"
        ms, fs = ("CASE WHEN sex = '%s' THEN r END" % g for g in "MF")
        return (
            f"{metrics}, {COV}, fx AS (SELECT {key}, sid, l.y, cv.sex, cv.age, cv.fd FROM lo l JOIN cv USING (sid) WHERE l.y IS NOT NULL), c AS (SELECT {key}, regr_slope(y, fd) AS b, regr_intercept(y, fd) AS a FROM fx GROUP BY {key}), "
            f"re AS (SELECT {key}, sid, sex, age, y - (a + b * fd) AS r FROM fx JOIN c USING ({key})), rs AS (SELECT {key}, sid, r, sex AS grp FROM re), rg AS (SELECT {key}, sid, r, age AS grp FROM re), {_dealt('rs', key, '_s')}, {_dealt('rg', key, '_a')}, "
            f"sx AS (SELECT {key}, perm, abs(avg({ms.replace('sex', 'grp')}) - avg({fs.replace('sex', 'grp')})) AS stat FROM dl_s GROUP BY {key}, perm), "
            f"gm AS (SELECT {key}, perm, avg(r) AS grand, sum((r - mu) * (r - mu)) AS sst FROM (SELECT *, avg(r) OVER (PARTITION BY {key}, perm) AS mu FROM dl_a) GROUP BY {key}, perm), lv AS (SELECT {key}, perm, grp, count(*) AS n, avg(r) AS m FROM dl_a GROUP BY {key}, perm, grp), "
            f"ag AS (SELECT {key}, perm, sum(n * (m - grand) * (m - grand)) / min(sst) AS stat FROM gm JOIN lv USING ({key}, perm) GROUP BY {key}, perm), "
            f"g AS (SELECT {key}, count({ms}) AS nm, count({fs}) AS nf, avg({ms}) AS m, avg({fs}) AS f, var_samp({ms}) AS vm, var_samp({fs}) AS vf FROM re GROUP BY {key}), "
            f"d AS (SELECT {key}, (m - f) / sqrt(((nm - 1) * vm + (nf - 1) * vf) / (nm + nf - 2)) AS effect FROM g), "
            f"al AS (SELECT {key}, 'Sex' AS factor, stat, p_perm, effect, 'cohen_d' AS effect_name FROM ({value % ('sx', 'sx')}) JOIN d USING ({key}) UNION ALL SELECT {key}, 'AgeGroup', stat, p_perm, stat, 'eta_sq' FROM ({value % ('ag', 'ag')})), "
            "ra AS (SELECT *, row_number() OVER (ORDER BY p_perm) AS i, count(*) OVER () AS m FROM al) "
            f"SELECT {key}, factor, {r6('stat')} AS stat, {r6('p_perm')} AS p_perm, {r6('effect')} AS effect, effect_name, {r6('least(min(p_perm * m / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)')} AS q_bh FROM ra"
        )

    occ3_wide = f"{_grid(3)}, {occ3}, {PAIRS}, {RUNS}, {DWELL}, {SWITCH}"
    state_metrics = f"{occ3_wide}, lo AS (SELECT sid, s, 'fo' AS metric, fo AS y FROM occ UNION ALL SELECT sid, s, 'dt_mean', dt_mean FROM dw UNION ALL SELECT sid, s, 'iv_mean', iv_mean FROM dw UNION ALL SELECT sid, s, 'sr_state', sr_state FROM sw)"
    out["stats_state_effects"] = f"{od.replace('WITH', 'WITH RECURSIVE')}{family_effects(state_metrics, 'metric, s')}"
    between = f"{changed}, lo AS (SELECT sid, 'sr_global' AS metric, sr AS y FROM sg UNION ALL SELECT sid, 'steps', CAST(steps AS DOUBLE) FROM sg)"
    out["stats_between_effects"] = f"{od.replace('WITH', 'WITH RECURSIVE')}{family_effects(between, 'metric')}"

    # the omnibus table: each term by itself, then q over all. A sid's values less their mean, of the states it has; of three
    # centred state columns one follows from the others, so two of them are solved for
    metrics = (
        f"w AS (SELECT o_custkey AS sid, {_case('o_orderstatus', roles.ORDER_STATES)} AS s, avg(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY 1, 2), cm AS (SELECT * FROM (SELECT 'mean_price' AS metric, sid, s, a AS y FROM w UNION ALL SELECT 'most_price', sid, s, b FROM w) WHERE sid IN (SELECT sid FROM cv)), "
        "ce AS (SELECT metric, sid, s, y - avg(y) OVER (PARTITION BY metric, sid) AS c, count(*) OVER (PARTITION BY metric, sid) AS n FROM cm), "
        "bk AS (SELECT metric, sid, min(n) AS n, sum(CASE WHEN s = 1 THEN c ELSE 0 END) AS c1, sum(CASE WHEN s = 2 THEN c ELSE 0 END) AS c2, sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS p2, sum(c * c) AS q FROM ce GROUP BY metric, sid), "
        f"pm AS (SELECT unnest(range({PERMUTATIONS + 1})) AS perm)"
    )
    solved = "CASE WHEN g11 * g22 - g12 * g12 > 1e-9 THEN (c1 * c1 * g22 - 2 * c1 * c2 * g12 + c2 * c2 * g11) / (g11 * g22 - g12 * g12) WHEN g11 > 1e-9 THEN c1 * c1 / g11 WHEN g22 > 1e-9 THEN c2 * c2 / g22 ELSE 0 END"
    products = "sum(p1 * (1 - p1 / n)) AS g11, sum(p2 * (1 - p2 / n)) AS g22, -sum(p1 * p2 / n) AS g12"

    def with_p(stats: str) -> str:
        return f"SELECT o.*, p FROM (SELECT * FROM {stats} WHERE perm = 0) o JOIN (SELECT s.metric, (sum(CASE WHEN s.f >= z.f * (1 - 1e-9) THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS p FROM {stats} s JOIN {stats} z ON z.metric = s.metric AND z.perm = 0 WHERE s.perm > 0 GROUP BY s.metric) x ON x.metric = o.metric"

    state_term = (
        "(WITH ss AS (SELECT metric, sid, s, row_number() OVER (PARTITION BY metric, sid ORDER BY s) AS j FROM ce), "
        "hs AS (SELECT metric, perm, sid, c, row_number() OVER (PARTITION BY metric, perm, sid ORDER BY CASE WHEN perm > 0 THEN md5('42:' || perm || ':' || sid || ':' || s) ELSE lpad(CAST(s AS VARCHAR), 20, '0') END, s) AS j FROM ce CROSS JOIN pm), "
        "cs AS (SELECT metric, perm, sum(CASE WHEN s = 1 THEN c ELSE 0 END) AS c1, sum(CASE WHEN s = 2 THEN c ELSE 0 END) AS c2 FROM hs JOIN ss USING (metric, sid, j) GROUP BY metric, perm), "
        f"ba AS (SELECT metric, count(*) AS nn, sum(n) AS rr, sum(q) AS q, {products} FROM bk GROUP BY metric), "
        f"fs AS (SELECT *, (gain / 2) / ((q - gain) / (rr - nn - 3)) AS f FROM (SELECT metric, perm, nn, rr, q, {solved} AS gain FROM cs JOIN ba USING (metric))) "
        f"SELECT metric, 'State' AS term, f AS f_obs, p AS p_perm, CAST(2 AS BIGINT) AS df_num, CAST(rr - nn - 3 AS BIGINT) AS df_den, gain / q AS partial_eta2 FROM ({with_p('fs')}))"
    )

    def terms(factor: str, name: str) -> str:
        dealt_ = f"sj AS (SELECT DISTINCT metric, sid, {factor} AS grp FROM bk JOIN cv USING (sid)), {_dealt('sj', 'metric')}"
        inner = (
            f"(WITH RECURSIVE {dealt_}, dg AS (SELECT metric, perm, grp, sum(c1) AS c1, sum(c2) AS c2, {products.replace('/ n)', '/ bk.n)')} FROM dl JOIN bk USING (metric, sid) GROUP BY metric, perm, grp), "
            f"cl AS (SELECT metric, perm, sum({solved}) AS cells FROM dg GROUP BY metric, perm), "
            f"ba AS (SELECT metric, nn, rr, q, g, {solved} AS st FROM (SELECT metric, count(*) AS nn, sum(bk.n) AS rr, sum(q) AS q, count(DISTINCT grp) AS g, sum(c1) AS c1, sum(c2) AS c2, {products.replace('/ n)', '/ bk.n)')} FROM bk JOIN sj USING (metric, sid) GROUP BY metric)), "
            "fi AS (SELECT metric, perm, ((cells - st) / ((g - 1) * 2)) / ((q - cells) / (rr - nn - g * 3)) AS f, CAST((g - 1) * 2 AS BIGINT) AS df_num, CAST(rr - nn - g * 3 AS BIGINT) AS df_den, (cells - st) / (q - st) AS eta FROM cl JOIN ba USING (metric)) "
            f"SELECT metric, '{name}:State' AS term, f AS f_obs, p AS p_perm, df_num, df_den, eta AS partial_eta2 FROM ({with_p('fi')}))"
        )
        main = f"(SELECT metric, '{name}', NULL, NULL, CAST(count(DISTINCT {factor}) - 1 AS BIGINT), CAST(sum(n) - count(*) - 3 - count(DISTINCT {factor}) + 1 AS BIGINT), NULL FROM bk JOIN cv USING (sid) GROUP BY metric)"
        return f"{inner} UNION ALL {main}"

    out["rm_omnibus"] = (
        f"WITH {COV}, {metrics}, al AS ({state_term} UNION ALL {terms('age', 'AgeGroup')} UNION ALL {terms('sex', 'Sex')}), ra AS (SELECT *, row_number() OVER (ORDER BY p_perm NULLS LAST) AS i, count(p_perm) OVER () AS m FROM al) "
        f"SELECT metric, term, {r6('f_obs')} AS f_obs, {r6('p_perm')} AS p_perm, df_num, df_den, {r6('partial_eta2')} AS partial_eta2, CASE WHEN p_perm IS NOT NULL THEN {r6('least(min(p_perm * m / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)')} END AS q_bh FROM ra"
    )
    out["series_files"] = f"SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, {r6('value')} AS value FROM events"
    out["series_shapes"] = "SELECT CAST(user_id AS VARCHAR) || '_value.txt' AS name, CAST(2 AS BIGINT) AS n_dim, count(*) AS rows, CAST(1 AS BIGINT) AS p, true AS keep FROM events GROUP BY user_id"
    # all events as one sequence
    one = f"WITH q AS (SELECT CAST(0 AS BIGINT) AS sid, row_number() OVER (ORDER BY ts, event_id) - 1 AS t, {_case('event_type', roles.EVENT_STATES)} AS s FROM events WHERE event_type IN ({', '.join(repr(x) for x in roles.EVENT_STATES)})), "
    out["one_sequence_dwell"] = f"{one}{_grid(5)}, {RUNS}, {DWELL} SELECT sid, s, {r6('dt_mean')} AS dt_mean, {r6('dt_median')} AS dt_median, {r6('dt_var')} AS dt_var, n_visits, {r6('iv_mean')} AS iv_mean FROM dw"
    out["one_sequence_transitions"] = f"{one}{_trans(5)} SELECT sid, from_s, to_s, n FROM tr"
    (a, b), (stay0, stay1), hit = roles.START, roles.STAY, roles.HIT
    miss = [1 - h for h in hit]
    bought = roles.EVENT_STATES.index("purchase")
    to0, to1 = f"(a0 * {stay0} + a1 * {1 - stay1})", f"(a0 * {1 - stay0} + a1 * {stay1})"
    out["hmm_one_sequence"] = (
        f"{one.replace('WITH', 'WITH RECURSIVE')}e AS MATERIALIZED (SELECT t, CASE WHEN s = {bought} THEN CAST({hit[0]} AS DOUBLE) ELSE {miss[0]} END AS e0, CASE WHEN s = {bought} THEN CAST({hit[1]} AS DOUBLE) ELSE {miss[1]} END AS e1 FROM q), "
        "l AS MATERIALIZED (SELECT list(e0 ORDER BY t) AS e0, list(e1 ORDER BY t) AS e1, count(*) AS n FROM e), "
        f"f AS (SELECT CAST(0 AS BIGINT) AS t, {a} * e0[1] / ({a} * e0[1] + {b} * e1[1]) AS a0, {b} * e1[1] / ({a} * e0[1] + {b} * e1[1]) AS a1, ln({a} * e0[1] + {b} * e1[1]) AS c FROM l UNION ALL "
        f"SELECT t + 1, {to0} * e0[t + 2] / ({to0} * e0[t + 2] + {to1} * e1[t + 2]), {to1} * e1[t + 2] / ({to0} * e0[t + 2] + {to1} * e1[t + 2]), ln({to0} * e0[t + 2] + {to1} * e1[t + 2]) FROM f, l WHERE t + 1 < n), "
        "g AS (SELECT n - 1 AS t, CAST(0.5 AS DOUBLE) AS b0, CAST(0.5 AS DOUBLE) AS b1 FROM l UNION ALL "
        f"SELECT t - 1, x0 / (x0 + x1), x1 / (x0 + x1) FROM (SELECT t, {stay0} * e0[t + 1] * b0 + {1 - stay0} * e1[t + 1] * b1 AS x0, {1 - stay1} * e0[t + 1] * b0 + {stay1} * e1[t + 1] * b1 AS x1 FROM g, l WHERE t > 0)) "
        f"SELECT f.t, {r6('a0 * b0 / (a0 * b0 + a1 * b1)')} AS g0, {r6('(SELECT sum(c) FROM f)')} AS loglik FROM f JOIN g ON g.t = f.t"
    )
    out["hmm_em_steps"] = _em_steps()
    # two regressors beside the tested one: their 2 x 2 system is solved in closed form
    out["parcel_glm_design"] = (
        f"WITH RECURSIVE {PARCELS}, dm AS (SELECT s_suppkey AS sid, CAST(1 AS DOUBLE) AS z1, s_acctbal / CAST(1000 AS DOUBLE) AS z2, CASE WHEN s_suppkey % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS x, CAST(s_nationkey % 3 AS BIGINT) AS block FROM supplier), "
        f"sj AS (SELECT s, sid, block, z1, z2, x, 0 AS grp FROM (SELECT DISTINCT s, sid FROM pa) JOIN dm USING (sid)), {_dealt('sj', 's, block')}, "
        "mo AS (SELECT s, count(*) AS n, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS d, sum(z1 * x) AS u, sum(z2 * x) AS v, sum(x * x) AS xx FROM sj GROUP BY s), "
        "mv AS (SELECT *, (d * u - b * v) / (a * d - b * b) AS k1, (a * v - b * u) / (a * d - b * b) AS k2, xx - (d * u * u - 2 * b * u * v + a * v * v) / (a * d - b * b) AS sxx FROM mo), "
        "zy AS (SELECT s, p, count(*) AS have, sum(z1 * value) AS g, sum(z2 * value) AS h FROM pa JOIN sj USING (s, sid) GROUP BY s, p), "
        "re AS (SELECT pa.s, pa.sid, pa.p, value - z1 * (d * g - b * h) / (a * d - b * b) - z2 * (a * h - b * g) / (a * d - b * b) AS r FROM pa JOIN sj USING (s, sid) JOIN zy ON zy.s = pa.s AND zy.p = pa.p JOIN mv ON mv.s = pa.s WHERE have = n), "
        "de AS (SELECT v.s, v.perm, v.sid, l.z1, l.z2, l.x FROM (SELECT * FROM wk WHERE x_ < n UNION ALL SELECT * FROM st WHERE perm = 0) v JOIN pl l ON l.s = v.s AND l.block = v.block AND l.place = v.x_), "
        "su AS (SELECT re.s, re.p, perm, sum((de.x - z1 * k1 - z2 * k2) * r) AS xr, sum(z1 * r) AS g, sum(z2 * r) AS h, sum(r * r) AS rr FROM re JOIN de USING (s, sid) JOIN mv ON mv.s = re.s GROUP BY re.s, re.p, perm), "
        "tt AS (SELECT su.s, p, perm, xr / sxx * sqrt(sxx) / sqrt((rr - (d * g * g - 2 * b * g * h + a * h * h) / (a * d - b * b) - xr * xr / sxx) / (n - 3)) AS t FROM su JOIN mv ON mv.s = su.s), "
        "mx AS (SELECT s, perm, max(t) AS most FROM tt WHERE perm > 0 GROUP BY s, perm), "
        f"fw AS (SELECT tt.s, p, t, (sum(CASE WHEN most >= t - abs(t) * 1e-9 THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS pv FROM tt JOIN mx ON mx.s = tt.s WHERE tt.perm = 0 GROUP BY tt.s, p, t) "
        f"SELECT e.s, e.p, {r6('t')} AS t, {r6('pv')} AS p_fwe FROM (SELECT DISTINCT s, p FROM pa) e LEFT JOIN fw ON fw.s = e.s AND fw.p = e.p"
    )
    return out
