"""DuckDB SQL of the queries, over common table expressions for the projections."""

from __future__ import annotations

H, D = 3_600_000, 86_400_000

BASE = f"""
ticks AS (
  SELECT event_type AS asset, CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'futures' END AS venue, event_id AS seq,
         epoch_us(ts) // 1000 AS recv_ts_ms, epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % {H} AS ts_ms,
         floor((100.0::DOUBLE + value / 100) * 100 + 0.5) / 100 AS price, (1 + event_id % 7)::DOUBLE AS qty,
         event_id % 2 = 1 AS buyer_is_maker, user_id % 3 = 0 AS is_buy
  FROM events
),
q AS (
  SELECT *, price - 0.01::DOUBLE * (1 + seq % 3) AS bid_price, price + 0.01::DOUBLE * (1 + seq % 2) AS ask_price,
         (1 + seq % 5)::DOUBLE AS bid_qty, (1 + seq % 4)::DOUBLE AS ask_qty FROM ticks
),
quotes AS (SELECT *, (bid_price * ask_qty + ask_price * bid_qty) / (bid_qty + ask_qty) AS micro, 0.5 * (bid_price + ask_price) AS mid FROM q),
spot AS (SELECT * FROM quotes WHERE venue = 'spot'),
span AS (SELECT asset, min(recv_ts_ms) AS lo, max(recv_ts_ms) AS hi FROM ticks GROUP BY asset),
prompts AS (SELECT asset, unnest(range(((lo + {H} - 1) // {H}) * {H}, hi + 1, {H})) AS t FROM span)
"""

WIN = f""",
win AS (
  SELECT p.asset, p.t AS current_time_ms, k.* EXCLUDE (asset) FROM prompts p JOIN ticks k
  ON k.asset = p.asset AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t
),
signed AS (SELECT *, CASE WHEN buyer_is_maker THEN -qty ELSE qty END AS s FROM win)
"""

LABELS = f""",
priced AS (SELECT p.asset, p.t AS current_time_ms, s.micro AS price FROM prompts p ASOF JOIN spot s ON p.asset = s.asset AND p.t >= s.recv_ts_ms),
labels AS (
  SELECT p.asset, p.t AS current_time_ms, p.t + {H} AS target_ms,
         CASE WHEN s.recv_ts_ms > p.t THEN s.seq END AS quote, CASE WHEN s.recv_ts_ms > p.t THEN s.recv_ts_ms END AS recv_ts_ms,
         CASE WHEN s.recv_ts_ms > p.t AND p.t + {H} - s.recv_ts_ms <= {H} THEN s.micro END AS realized
  FROM prompts p ASOF LEFT JOIN spot s ON p.asset = s.asset AND p.t + {H} >= s.recv_ts_ms
),
models AS (SELECT i AS model_no, 'm' || i AS model FROM range(8) r(i)),
grid AS (SELECT i, (2 * i - 1) / 200.0::DOUBLE AS tau FROM range(1, 101) g(i)),
z AS (SELECT i, tau, CASE WHEN tau < 0.5 THEN ln(1 - 2 * abs(tau - 0.5)) ELSE -ln(1 - 2 * abs(tau - 0.5)) END AS z FROM grid),
answers AS (SELECT p.*, model_no, model FROM priced p CROSS JOIN models WHERE (current_time_ms // {H} + model_no) % 11 <> 0),
ladder AS (SELECT a.*, i, tau, price + (model_no - 3) * 0.05::DOUBLE + (0.2::DOUBLE + 0.1::DOUBLE * model_no) * z AS x FROM answers a CROSS JOIN z)
"""

#: The two days before each prompt: spot quotes numbered, every ceil(n / 16)-th a start, its end the last row three hours on.
PAIRS = f""",
w AS (
  SELECT p.asset, p.t, k.recv_ts_ms AS ms, k.micro, row_number() OVER (PARTITION BY p.asset, p.t ORDER BY k.recv_ts_ms, k.seq) - 1 AS i, count(*) OVER (PARTITION BY p.asset, p.t) AS n
  FROM prompts p JOIN spot k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 48 * {H} AND k.recv_ts_ms <= p.t
),
ends AS (
  SELECT a.asset, a.t, a.n, a.i, max(b.i) AS j FROM w a JOIN w b ON a.asset = b.asset AND a.t = b.t AND b.ms <= a.ms + 3 * {H}
  WHERE a.i % ceil(a.n / 16.0)::INT = 0 GROUP BY ALL
),
pairs AS (
  SELECT e.asset, e.t, e.n, y.micro - x.micro AS move FROM ends e JOIN w x ON x.asset = e.asset AND x.t = e.t AND x.i = e.i
  JOIN w y ON y.asset = e.asset AND y.t = e.t AND y.i = e.j WHERE e.j > e.i AND y.ms - x.ms >= 2 * {H}
),
kept AS (SELECT asset, t AS current_time_ms, n AS n_ticks, count(*) AS n_pairs, sum(move) AS total, list(move) AS moves FROM pairs WHERE n >= 20 GROUP BY ALL HAVING count(*) >= 8)
"""

#: Quotes of the last 40 of 48 hours, at most 16 of them: evenly spaced, both ends included.
THINNED = f""",
w AS (
  SELECT p.asset, k.venue, p.t, k.recv_ts_ms AS ms, k.seq, k.micro, max(k.recv_ts_ms) OVER (PARTITION BY p.asset, k.venue, p.t) AS newest
  FROM prompts p JOIN quotes k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 48 * {H} AND k.recv_ts_ms <= p.t
),
m AS (SELECT asset, venue, t, micro, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY asset, venue, t) AS n FROM w WHERE ms > newest - 40 * {H} WINDOW o AS (PARTITION BY asset, venue, t ORDER BY ms, seq)),
wanted AS (SELECT DISTINCT asset, venue, t, CASE WHEN k = 15 THEN n - 1 ELSE floor(k * ((n - 1) / 15.0::DOUBLE))::BIGINT END AS i, k FROM (SELECT DISTINCT asset, venue, t, n FROM m WHERE n > 16) c CROSS JOIN range(16) g(k)),
picked AS (SELECT asset, venue, t, i, i AS k, micro FROM m WHERE n <= 16 UNION ALL SELECT asset, venue, t, i, k, micro FROM m JOIN wanted USING (asset, venue, t, i)),
steps AS (SELECT *, ln(micro / lag(micro) OVER (PARTITION BY asset, venue, t ORDER BY k)) AS r FROM picked)
"""

SCORES = (
    LABELS
    + """,
crps AS (
  SELECT l.asset, l.current_time_ms, l.model, sum((b.realized - x) * (tau - CASE WHEN b.realized < x THEN 1.0 ELSE 0.0 END)) * (2.0 / 100) AS crps
  FROM ladder l JOIN labels b ON l.asset = b.asset AND l.current_time_ms = b.current_time_ms WHERE b.realized IS NOT NULL
  GROUP BY ALL
),
scores AS (
  SELECT p.asset, p.current_time_ms, m.model, c.crps, c.crps IS NOT NULL AS answered
  FROM priced p JOIN labels b ON p.asset = b.asset AND p.current_time_ms = b.current_time_ms AND b.realized IS NOT NULL CROSS JOIN models m
  LEFT JOIN crps c ON c.asset = p.asset AND c.current_time_ms = p.current_time_ms AND c.model = m.model
),
charged AS (SELECT *, coalesce(crps, quantile_cont(crps, 0.95) OVER w) AS charged FROM scores WINDOW w AS (PARTITION BY asset, current_time_ms)),
field AS (SELECT asset, current_time_ms, model, charged - min(charged) OVER (PARTITION BY asset, current_time_ms) AS field_score FROM charged WHERE charged IS NOT NULL)
"""
)

CANDLES = f""",
candles AS (
  SELECT asset, venue, ts_ms AS open_time_ms, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume
  FROM ticks GROUP BY ALL
),
bars AS (SELECT asset, venue, unnest(range(min(open_time_ms), max(open_time_ms) + 1, {H})) AS open_time_ms FROM candles GROUP BY asset, venue),
filled AS (
  SELECT b.*, last_value(c.close IGNORE NULLS) OVER (PARTITION BY b.asset, b.venue ORDER BY b.open_time_ms ROWS UNBOUNDED PRECEDING) AS close, coalesce(c.volume, 0) AS volume
  FROM bars b LEFT JOIN candles c USING (asset, venue, open_time_ms)
),
moved AS (
  SELECT *, close - lag(close, 1) OVER w AS d_one, close - lag(close, 3) OVER w AS d_three, close - lag(close, 10) OVER w AS d_ten,
         ln(close / lag(close, 1) OVER w) AS r_one, ln(close / lag(close, 3) OVER w) AS r_three, ln(close / lag(close, 10) OVER w) AS r_ten
  FROM filled WINDOW w AS (PARTITION BY asset, venue ORDER BY open_time_ms)
)
"""
AGED = """,
aged AS (SELECT *, row_number() OVER (PARTITION BY asset, venue ORDER BY open_time_ms DESC) - 1 AS age FROM moved WHERE {cond})
"""
SEASON = """,
seas AS (
  SELECT ((open_time_ms // 600000 - 576) % 1008 + 1008) % 1008 AS slot, avg(abs(d_ten)) AS seas_abs, count(*) AS n FROM moved WHERE d_ten IS NOT NULL GROUP BY ALL
),
usual AS (SELECT slot // 6 % 24 AS hour, sum(seas_abs * n) / sum(n) AS usual FROM seas WHERE slot < 720 GROUP BY ALL)
"""
GROUPS = """,
all_groups AS (SELECT asset, venue, ts_ms, arg_max(price, seq) AS price, arg_max(recv_ts_ms, seq) AS recv_ts_ms, max(seq) AS seq, count(*) AS n FROM ticks GROUP BY ALL),
groups AS (SELECT * FROM all_groups QUALIFY ts_ms < max(ts_ms) OVER (PARTITION BY asset, venue))
"""
MOVES = (
    GROUPS
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY asset, venue ORDER BY ts_ms, seq) AS nth FROM groups),
fold AS (
  SELECT asset, venue, nth, ts_ms, price, recv_ts_ms, seq, false AS move, NULL::DOUBLE AS reference, price AS held FROM numbered WHERE nth = 1
  UNION ALL
  SELECT n.asset, n.venue, n.nth, n.ts_ms, n.price, n.recv_ts_ms, n.seq, abs(n.price - f.held) / 0.5 > 1 + 1e-6,
         f.held, CASE WHEN abs(n.price - f.held) / 0.5 > 1 + 1e-6 THEN n.price ELSE f.held END
  FROM fold f JOIN numbered n ON n.asset = f.asset AND n.venue = f.venue AND n.nth = f.nth + 1
),
moves AS (SELECT * FROM fold WHERE move)
"""
)
UNIT = "(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
COIN = UNIT.format(text="'coin|' || asset || '|' || venue || '|' || recv_ts_ms")
DELAY = UNIT.format(text="'delay|' || asset || '|' || venue || '|' || recv_ts_ms")
DELAYED = f"CASE WHEN {DELAY} < 0.5 THEN 0 ELSE floor(({DELAY} - 0.5) * 2 * 500) END::BIGINT"
ALL_PROMPTS = (
    MOVES
    + f""",
taken AS (SELECT *, recv_ts_ms - recv_ts_ms % {H} AS slot FROM moves WHERE recv_ts_ms % {H} >= 600000 AND recv_ts_ms % {H} < 3000000 AND {COIN} < 0.5),
firsts AS (SELECT asset, recv_ts_ms + {DELAYED} AS current_time_ms, 'event' AS kind, venue FROM taken QUALIFY row_number() OVER (PARTITION BY asset, slot ORDER BY recv_ts_ms, venue, seq) = 1),
built AS (
  SELECT asset, current_time_ms, max(kind) AS kind, CASE WHEN max(kind) = 'event' THEN max(venue) END AS venue
  FROM (SELECT asset, t AS current_time_ms, 'time' AS kind, NULL AS venue FROM prompts UNION ALL SELECT * FROM firsts) GROUP BY ALL
)
""".replace("GROUP BY ALL\n)", "GROUP BY asset, current_time_ms\n)")
)
LEVELS = """,
lv AS (
  SELECT asset, venue, seq, recv_ts_ms, i, 'bid' AS side, bid_price + i * -0.01::DOUBLE AS price, (1 + (seq + i) % 9)::DOUBLE AS qty FROM quotes CROSS JOIN range(20) r(i)
  UNION ALL
  SELECT asset, venue, seq, recv_ts_ms, i, 'ask', ask_price + i * 0.01::DOUBLE, (1 + (seq + i) % 9)::DOUBLE FROM quotes CROSS JOIN range(20) r(i)
)
"""
COUNTS = f""",
counts AS (
  SELECT asset, venue, current_time_ms, count(*) FILTER (WHERE current_time_ms - recv_ts_ms < {H}) AS n_1h,
    coalesce(sum(qty) FILTER (WHERE current_time_ms - recv_ts_ms < {H}), 0) AS vol_1h, coalesce(sum(s) FILTER (WHERE current_time_ms - recv_ts_ms < {H}), 0) AS flow_1h,
    max(price) FILTER (WHERE current_time_ms - recv_ts_ms < {H}) - min(price) FILTER (WHERE current_time_ms - recv_ts_ms < {H}) AS range_1h,
    sum(price * qty) FILTER (WHERE current_time_ms - recv_ts_ms < {H}) / sum(qty) FILTER (WHERE current_time_ms - recv_ts_ms < {H}) AS vwap_1h,
    count(*) AS n_6h, sum(qty) AS vol_6h, sum(s) AS flow_6h, max(price) - min(price) AS range_6h, sum(price * qty) / sum(qty) AS vwap_6h
  FROM signed GROUP BY ALL
)
"""

FEATURES = (
    WIN
    + f""",
qw AS (
  SELECT p.t AS current_time_ms, k.*, max(k.recv_ts_ms) OVER (PARTITION BY p.asset, p.t, k.venue) AS newest FROM prompts p JOIN quotes k
  ON k.asset = p.asset AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t
),
bk AS (
  SELECT asset, current_time_ms, venue, arg_max(micro, recv_ts_ms) AS micro, arg_max(mid, recv_ts_ms) AS mid, arg_max(greatest(ask_price - bid_price, 0), recv_ts_ms) AS spread,
         arg_max((bid_qty - ask_qty) / (bid_qty + ask_qty), recv_ts_ms) AS imb, max(recv_ts_ms) AS recv,
         arg_max(micro, recv_ts_ms) FILTER (WHERE recv_ts_ms <= newest - {H}) AS at1, arg_max(micro, recv_ts_ms) FILTER (WHERE recv_ts_ms <= newest - 3 * {H}) AS at3
  FROM qw GROUP BY ALL
),
rr AS (SELECT *, ln(micro / lag(micro) OVER (PARTITION BY asset, venue, current_time_ms ORDER BY recv_ts_ms)) AS r FROM qw WHERE recv_ts_ms > newest - 5 * {H}),
vol AS (SELECT asset, venue, current_time_ms, stddev_pop(r) * sqrt(count(r)) AS rv, ln(max(micro) / min(micro)) AS rng FROM rr GROUP BY ALL HAVING count(*) >= 3),
bv AS (
  SELECT *, coalesce(ln(micro / at1), 0) AS m1, coalesce(ln(micro / at3), 0) AS m3 FROM bk LEFT JOIN vol USING (asset, current_time_ms, venue)
),
tb AS (SELECT *, row_number() OVER (PARTITION BY asset, venue, current_time_ms ORDER BY recv_ts_ms DESC, seq DESC) AS back, max(recv_ts_ms) OVER (PARTITION BY asset, venue, current_time_ms) AS newest FROM signed),
tf AS (
  SELECT asset, venue, current_time_ms, sum(s) / sum(qty) AS flow, sum(s) FILTER (WHERE back <= 5) / sum(qty) FILTER (WHERE back <= 5) AS flow_fast,
         sum(s) FILTER (WHERE recv_ts_ms >= newest - 2 * {H}) / sum(qty) FILTER (WHERE recv_ts_ms >= newest - 2 * {H}) AS flow_window, sum(qty) FILTER (WHERE recv_ts_ms >= newest - 2 * {H}) AS qty_window
  FROM tb GROUP BY ALL
),
liq AS (
  SELECT asset, current_time_ms, tanh(coalesce(sum(CASE WHEN is_buy THEN qty ELSE -qty END) FILTER (WHERE recv_ts_ms >= current_time_ms - {H}), 0) / 10.0) AS liq_dir, tanh(sum(qty) / 100.0) AS liq_hour
  FROM win WHERE asset = 'error' GROUP BY ALL
),
dq AS (SELECT seq, i, (1 + (seq + i) % 9)::DOUBLE AS qty FROM ticks CROSS JOIN range(20) r(i)),
v AS (
  SELECT bv.*, tf.flow, tf.flow_fast, tf.flow_window, tf.qty_window FROM bv LEFT JOIN tf USING (asset, venue, current_time_ms)
),
pv AS (
  SELECT p.asset, p.t AS current_time_ms, s.micro AS s_micro, s.mid AS s_mid, f.micro AS f_micro, f.mid AS f_mid, s.spread AS s_spread, s.recv AS s_recv, f.recv AS f_recv,
    s.flow AS s_flow, f.flow AS f_flow, s.flow_fast AS s_fast, f.flow_fast AS f_fast, liq_dir, liq_hour,
    s.imb AS s_imb, s.m1 AS s_m1, s.m3 AS s_m3, s.rv AS s_rv, s.rng AS s_rng, s.flow_window AS s_flow_window, s.qty_window AS s_qty_window,
    f.imb AS f_imb, f.m1 AS f_m1, f.m3 AS f_m3, f.rv AS f_rv, f.rng AS f_rng, f.flow_window AS f_flow_window, f.qty_window AS f_qty_window
  FROM prompts p LEFT JOIN (SELECT * FROM v WHERE venue = 'spot') s ON s.asset = p.asset AND s.current_time_ms = p.t
  LEFT JOIN (SELECT * FROM v WHERE venue = 'futures') f ON f.asset = p.asset AND f.current_time_ms = p.t
  LEFT JOIN liq ON liq.asset = p.asset AND liq.current_time_ms = p.t
),
feat AS (
  SELECT asset, current_time_ms, coalesce(s_micro, s_mid, f_micro, f_mid, 1.0) AS price, coalesce(s_mid, s_micro, f_micro, f_mid, 1.0) AS mid, 0.0::DOUBLE AS obi, 0.0::DOUBLE AS top_obi,
    0.5 * (coalesce(s_flow, 0) + coalesce(f_flow, 0)) AS flow, 0.5 * (coalesce(s_fast, 0) + coalesce(f_fast, 0)) AS flow_fast,
    coalesce(s_imb, 0) AS s_imb, coalesce(s_m1, 0) AS s_m1, coalesce(s_m3, 0) AS s_m3, coalesce(s_rv, 0) AS s_rv, coalesce(s_rng, 0) AS s_rng, coalesce(s_flow_window, 0) AS s_flow_window, coalesce(s_qty_window, 0) AS s_qty_window,
    coalesce(f_imb, 0) AS f_imb, coalesce(f_m1, 0) AS f_m1, coalesce(f_m3, 0) AS f_m3, coalesce(f_rv, 0) AS f_rv, coalesce(f_rng, 0) AS f_rng, coalesce(f_flow_window, 0) AS f_flow_window, coalesce(f_qty_window, 0) AS f_qty_window,
    CASE WHEN s_micro > 0 AND f_micro IS NOT NULL THEN (f_micro - s_micro) / s_micro ELSE 0 END AS basis, coalesce(s_spread / coalesce(s_micro, 1.0), 0) AS spread_rel,
    coalesce(greatest(current_time_ms - s_recv, current_time_ms - f_recv), 0) AS stale_ms, coalesce(liq_dir, 0) AS liq_dir, coalesce(liq_hour, 0) AS liq_hour
  FROM pv
)
"""
)
FEATURE_NAMES = ("price", "mid", "obi", "top_obi", "flow", "flow_fast", *(f"{p}_{c}" for p in "sf" for c in ("imb", "m1", "m3", "rv", "rng", "flow_window", "qty_window")), "basis", "spread_rel", "liq_dir", "liq_hour")


STILL = f""",
pts AS (SELECT asset, unnest(range(min(t) - 28 * {H}, max(t) + 1, {H})) AS t FROM prompts GROUP BY asset),
gs AS (SELECT p.asset, p.t, s.mid, s.bid_qty, s.ask_qty, greatest(s.ask_price - s.bid_price, 0) AS spread FROM pts p ASOF JOIN spot s ON p.asset = s.asset AND p.t >= s.recv_ts_ms),
gf AS (SELECT p.asset, p.t, s.mid FROM pts p ASOF JOIN (SELECT * FROM quotes WHERE venue = 'futures') s ON p.asset = s.asset AND p.t >= s.recv_ts_ms),
cs AS (SELECT *, coalesce(abs(mid - lag(mid) OVER w) > 0.005, false)::INT AS changed, (abs(mid - lag(mid, 4) OVER w) <= 0.005)::INT AS held FROM gs WINDOW w AS (PARTITION BY asset ORDER BY t)),
cf AS (SELECT *, coalesce(abs(mid - lag(mid) OVER w) > 0.005, false)::INT AS changed FROM gf WINDOW w AS (PARTITION BY asset ORDER BY t)),
ds AS (
  SELECT *, sum(changed) OVER (w ROWS 23 PRECEDING) AS n60, sum(changed) OVER (w ROWS 5 PRECEDING) AS n10, avg(held) OVER (w ROWS 23 PRECEDING) AS p0,
         t - last_value(CASE WHEN changed = 1 THEN t END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS since FROM cs WINDOW w AS (PARTITION BY asset ORDER BY t)
),
df AS (SELECT asset, t, sum(changed) OVER (w ROWS 23 PRECEDING) AS f60, sum(changed) OVER (w ROWS 5 PRECEDING) AS f10 FROM cf WINDOW w AS (PARTITION BY asset ORDER BY t)),
sf AS (
  SELECT p.asset, p.t, coalesce(sum(qty) FILTER (WHERE NOT buyer_is_maker), 0) AS bought, coalesce(sum(qty) FILTER (WHERE buyer_is_maker), 0) AS sold
  FROM prompts p LEFT JOIN spot k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t GROUP BY p.asset, p.t
),
hw AS (SELECT asset, open_time_ms, CASE WHEN count(*) OVER w = 11 THEN (max(close) OVER w - min(close) OVER w <= 4.0)::INT END AS held FROM filled WHERE venue = 'spot' WINDOW w AS (PARTITION BY asset ORDER BY open_time_ms ROWS 10 PRECEDING)),
hs AS (SELECT asset, open_time_ms + {H} AS t, avg(held) OVER (w ROWS 71 PRECEDING) AS h30, avg(held) OVER (w ROWS 23 PRECEDING) AS h5 FROM hw WINDOW w AS (PARTITION BY asset ORDER BY open_time_ms))
"""
STILL_OUT = f"""
SELECT p.asset, p.t AS current_time_ms, round(p0, 6) AS p0book, round(exp(-n60 / 6), 6) AS pois60, round(ln(1 + n10), 6) AS nchg10, round(ln(1 + least(coalesce(since + {H}, 24 * {H}), 24 * {H}) / 1000), 6) AS age,
  round(ln(1 + greatest(least(bid_qty, ask_qty), 0)), 6) AS minq, round(least(ln((bid_qty + 0.001) / (sold + 0.05)), ln((ask_qty + 0.001) / (bought + 0.05))), 6) AS q_flow, round(least(greatest(spread * 20.0, 0), 1), 6) AS spread,
  round(ln(1 + coalesce(f10, 0)), 6) AS fchg10, round(ln(1 + coalesce(f60, 0)), 6) AS fchg60, round(coalesce(h30, 0), 6) AS p0range30m, round(coalesce(h5, 0), 6) AS p0range5m,
  round(CASE WHEN seas_abs > 0 THEN ln(seas_abs) ELSE 0 END, 6) AS seas, 0.0 AS m0
FROM prompts p JOIN ds ON ds.asset = p.asset AND ds.t = p.t AND ds.p0 IS NOT NULL LEFT JOIN df ON df.asset = p.asset AND df.t = p.t LEFT JOIN sf ON sf.asset = p.asset AND sf.t = p.t
ASOF LEFT JOIN hs ON hs.asset = p.asset AND p.t >= hs.t LEFT JOIN seas ON seas.slot = ((p.t // 600000 - 576) % 1008 + 1008) % 1008
"""

_CHANGES, _FLOWS, _QUOTES = (250, 500, 1000, 2000, 5000), (500, 2000, 10_000), (1000, 5000, 10_000, 60_000)
SIGNALS = (
    f""",
kq AS (SELECT p.t, p.t - k.recv_ts_ms AS age, k.* FROM prompts p JOIN quotes k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 60000 * 360 AND k.recv_ts_ms <= p.t),
vq AS (
  SELECT asset, t, venue, count(*) AS n, min(recv_ts_ms) AS first, arg_max(mid, recv_ts_ms) AS mid, arg_max(micro, recv_ts_ms) AS micro,
    {", ".join(f"coalesce(arg_max(mid, recv_ts_ms) FILTER (WHERE age >= {w} * 360), arg_min(mid, recv_ts_ms)) AS mid{w}" for w in _CHANGES)},
    {", ".join(f"(count(*) FILTER (WHERE age < {w} * 360))::DOUBLE AS nbt{w}" for w in _QUOTES)},
    {", ".join(f"coalesce(max(mid) FILTER (WHERE age < {w}000 * 360) - min(mid) FILTER (WHERE age < {w}000 * 360), 0) AS brng{w}" for w in (10, 60))}
  FROM kq GROUP BY asset, t, venue
),
bk AS (SELECT s.asset, s.t, s AS s, f AS f FROM vq s JOIN vq f ON s.asset = f.asset AND s.t = f.t AND s.venue = 'spot' AND f.venue = 'futures' AND s.n >= 5 AND f.n >= 5),
gp AS (SELECT asset, unnest(range(min(t) - 60000 * 360 + {H} // 10, max(t) + 1, {H} // 10)) AS g FROM prompts GROUP BY asset),
gb AS (SELECT gp.asset, gp.g, f.mid - s.mid AS basis FROM gp ASOF JOIN spot s ON gp.asset = s.asset AND gp.g >= s.recv_ts_ms ASOF JOIN (SELECT * FROM quotes WHERE venue = 'futures') f ON gp.asset = f.asset AND gp.g >= f.recv_ts_ms),
bd AS (
  SELECT bk.asset, bk.t, any_value(bk.f.mid - bk.s.mid) AS now, {", ".join(f"avg(basis) FILTER (WHERE bk.t - g < {w}000 * 360) AS m{w}" for w in (5, 15, 30, 60))}
  FROM bk JOIN gb ON gb.asset = bk.asset AND g > bk.t - 60000 * 360 AND g <= bk.t AND g >= greatest(bk.s.first, bk.f.first) GROUP BY bk.asset, bk.t
),
kt AS (
  SELECT asset, t, venue, arg_max(price, recv_ts_ms) AS px, arg_max(CASE WHEN buyer_is_maker THEN -1.0 ELSE 1.0 END, recv_ts_ms) AS side, min(age)::DOUBLE AS last_age,
    {", ".join(f"coalesce(sum(CASE WHEN buyer_is_maker THEN -qty ELSE qty END) FILTER (WHERE age < {w} * 360), 0) AS flow{w}, coalesce(sum(qty) FILTER (WHERE age < {w} * 360), 0) AS vol{w}, (count(*) FILTER (WHERE age < {w} * 360))::DOUBLE AS n{w}" for w in _FLOWS)},
    sum(price * qty) FILTER (WHERE age < 10000 * 360) / sum(qty) FILTER (WHERE age < 10000 * 360) AS vwap
  FROM kq GROUP BY asset, t, venue
),
walk AS (SELECT *, sum(price * qty) OVER (PARTITION BY seq, side ORDER BY i) AS total FROM lv),
dsn AS (
  SELECT asset, venue, seq, any_value(recv_ts_ms) AS recv_ts_ms,
    {", ".join(f"(sum(qty) FILTER (WHERE side = 'bid' AND i < {n}) - sum(qty) FILTER (WHERE side = 'ask' AND i < {n})) / sum(qty) FILTER (WHERE i < {n}) AS dimb{n}" for n in (1, 3, 10, 20))},
    max(price) FILTER (WHERE side = 'ask') - min(price) FILTER (WHERE side = 'bid') AS dspan,
    abs(coalesce(arg_min(price, i) FILTER (WHERE side = 'bid' AND total >= 2000), min(price) FILTER (WHERE side = 'bid')) - max(price) FILTER (WHERE side = 'bid'))
      - abs(coalesce(arg_min(price, i) FILTER (WHERE side = 'ask' AND total >= 2000), max(price) FILTER (WHERE side = 'ask')) - min(price) FILTER (WHERE side = 'ask')) AS dthin
  FROM walk GROUP BY asset, venue, seq
),
full_bars AS (SELECT f.asset, f.venue, f.open_time_ms, f.close, coalesce(c.high, f.close) - coalesce(c.low, f.close) AS rng, abs(f.close - lag(f.close, 10) OVER (PARTITION BY f.asset, f.venue ORDER BY f.open_time_ms)) AS move
  FROM filled f LEFT JOIN candles c USING (asset, venue, open_time_ms)),
cb AS (
  SELECT asset, venue, open_time_ms + {H} AS t, row_number() OVER w AS nth, {", ".join(f"avg(move) OVER (w ROWS {w // 10 - 1} PRECEDING) AS mad{w}" for w in (60, 300, 900, 3600))},
    {", ".join(f"avg(rng) OVER (w ROWS {w // 10 - 1} PRECEDING) AS rng{w}" for w in (10, 60, 300))} FROM full_bars WINDOW w AS (PARTITION BY asset, venue ORDER BY open_time_ms)
),
lq AS (
  SELECT p.asset, p.t, {", ".join(f"coalesce(sum(CASE WHEN is_buy THEN qty ELSE -qty END) FILTER (WHERE p.t - k.recv_ts_ms < {w}000::BIGINT * 360), 0) AS liq_signed{w}, (count(k.seq) FILTER (WHERE p.t - k.recv_ts_ms < {w}000::BIGINT * 360))::DOUBLE AS liq_n{w}" for w in (10, 60, 600))}
  FROM prompts p LEFT JOIN ticks k ON k.asset = p.asset AND k.asset = 'error' AND k.recv_ts_ms > p.t - 600000::BIGINT * 360 AND k.recv_ts_ms <= p.t GROUP BY p.asset, p.t
),
wide AS (
  SELECT bk.asset, bk.t AS current_time_ms, 0.0::DOUBLE AS venue_fut, {", ".join(f"now - m{w} AS bdev{w}" for w in (5, 15, 30, 60))},
    {", ".join(f"bk.f.mid - bk.f.mid{w} AS fchg{w}, bk.s.mid - bk.s.mid{w} AS schg{w}, bk.f.mid - bk.f.mid{w} - (bk.s.mid - bk.s.mid{w}) AS lead{w}" for w in _CHANGES)},
    """
    + ", ".join(
        f"bk.{v}.micro - bk.{v}.mid AS {v}_micro_mid, t{v}.px - bk.{v}.micro AS {v}_lastpx_vs_micro, t{v}.side AS {v}_last_side, t{v}.last_age AS {v}_last_age, t{v}.vwap - bk.{v}.micro AS {v}_vwap10_vs_micro, "
        + ", ".join(f"t{v}.{n}{w} AS {v}_{n}{w}" for w in _FLOWS for n in ("flow", "vol", "n"))
        + ", "
        + ", ".join(f"d{v}.{c} AS {v}_{c}" for c in ("dimb1", "dimb3", "dimb10", "dimb20", "dspan", "dthin"))
        + ", "
        + ", ".join(f"bk.{v}.{c} AS {v}_{c}" for c in (*[f"nbt{w}" for w in _QUOTES], "brng10", "brng60"))
        for v in "sf"
    )
    + f""",
    {", ".join(f"c.mad{w} AS c_mad{w}" for w in (60, 300, 900, 3600))}, {", ".join(f"c.rng{w} AS c_rng{w}" for w in (10, 60, 300))}, g.mad60 AS fc_mad60, g.mad300 AS fc_mad300,
    {", ".join(f"liq_signed{w}, liq_n{w}" for w in (10, 60, 600))}
  FROM bk LEFT JOIN bd ON bd.asset = bk.asset AND bd.t = bk.t LEFT JOIN kt ts ON ts.asset = bk.asset AND ts.t = bk.t AND ts.venue = 'spot' LEFT JOIN kt tf ON tf.asset = bk.asset AND tf.t = bk.t AND tf.venue = 'futures'
  LEFT JOIN lq ON lq.asset = bk.asset AND lq.t = bk.t
  ASOF LEFT JOIN (SELECT * FROM dsn WHERE venue = 'spot') ds ON ds.asset = bk.asset AND bk.t >= ds.recv_ts_ms ASOF LEFT JOIN (SELECT * FROM dsn WHERE venue = 'futures') df ON df.asset = bk.asset AND bk.t >= df.recv_ts_ms
  ASOF LEFT JOIN (SELECT * FROM cb WHERE venue = 'spot' AND nth >= 24) c ON c.asset = bk.asset AND bk.t >= c.t ASOF LEFT JOIN (SELECT * FROM cb WHERE venue = 'futures' AND nth >= 24) g ON g.asset = bk.asset AND bk.t >= g.t
)
"""
)
SIGNALS_OUT = "SELECT asset, current_time_ms, signal, round(value, 6) + 0.0::DOUBLE AS value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (asset, current_time_ms)) INTO NAME signal VALUE value)"


def _sql(ctes: str, body: str = "") -> str:
    return f"WITH RECURSIVE {BASE}{ctes} {body}"


def oracle_sql() -> dict[str, str]:
    clip6 = "(CASE WHEN {x} < -6 THEN -6 WHEN {x} > 6 THEN 6 ELSE {x} END / 3)"
    z = clip6.format(x="((flow_6h - 0.5) / 8.0::DOUBLE)")
    z1 = clip6.format(x="((ln(1 + n_6h) - 1.5) / 0.7::DOUBLE)")
    stats = "count(*) AS n, count(crps) AS n_scored, count(*) - count(crps) AS n_dropped, round(avg(crps), 6) AS crps_mean, round(quantile_cont(crps, 0.5), 6) AS crps_median, round(min(crps), 6) AS crps_min, round(max(crps), 6) AS crps_max, min(current_time_ms) AS first_ms, max(current_time_ms) AS last_ms"
    board = "board AS (SELECT f.asset, f.model, avg(field_score) AS score, count(*) AS n_prompts FROM field f WHERE (f.asset, f.model) IN (SELECT (asset, model) FROM scores WHERE answered) GROUP BY ALL), ranked AS (SELECT *, rank() OVER (PARTITION BY asset ORDER BY round(score, 9)) AS rank FROM board)"
    return {
        "p1_quote_measures": _sql("", "SELECT asset, venue, seq, round(micro, 6) AS micro, round(mid, 6) AS mid, round(greatest(ask_price - bid_price, 0), 6) AS spread, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 6) AS imbalance, bid_price > 0 AND ask_price > 0 AND bid_qty + ask_qty > 0 AS valid FROM quotes"),
        "p9_complete_history": _sql(CANDLES, f"SELECT asset, venue, count(*) AS n_bars, max(open_time_ms) - min(open_time_ms) AS span_ms, count(*) >= 600 AND max(open_time_ms) - min(open_time_ms) >= 599::BIGINT * {H} AS complete FROM candles GROUP BY ALL"),
        "p11_price_scale": _sql("", "SELECT asset, venue, seq, round(CASE WHEN asset <> 'click' AND price > 0 THEN price / 101.0::DOUBLE ELSE 1 END, 6) AS scale FROM ticks"),
        "p12_moved_trades": _sql("", "SELECT asset, venue, seq, abs(price - before) / 0.5 > 1 + 1e-6 AS moved FROM (SELECT *, lag(price) OVER (PARTITION BY asset, venue ORDER BY recv_ts_ms, seq) AS before FROM ticks) WHERE before IS NOT NULL"),
        "p14_staleness": _sql(WIN, "SELECT asset, current_time_ms, current_time_ms - max(recv_ts_ms) AS stale_ms, count(DISTINCT venue)::INT AS n_streams FROM win GROUP BY asset, current_time_ms"),
        "p16_last_trade_gap": _sql(LABELS, "SELECT p.asset, current_time_ms, round(s.price - p.price, 6) + 0.0::DOUBLE AS gap, CASE WHEN s.buyer_is_maker THEN -1 ELSE 1 END AS side, current_time_ms - s.recv_ts_ms AS age_ms FROM priced p ASOF JOIN spot s ON p.asset = s.asset AND p.current_time_ms >= s.recv_ts_ms"),
        "j1_asof_quotes": _sql("", f"SELECT t.asset, t.seq AS trade, CASE WHEN t.recv_ts_ms - s.recv_ts_ms <= 4 * {H} THEN s.seq END AS quote, CASE WHEN t.recv_ts_ms - s.recv_ts_ms <= 4 * {H} THEN round(s.bid_price, 6) END AS bid_price FROM (SELECT * FROM ticks WHERE venue = 'futures') t ASOF LEFT JOIN spot s ON t.asset = s.asset AND t.recv_ts_ms >= s.recv_ts_ms"),
        "j2_label_quotes": _sql(LABELS, "SELECT asset, current_time_ms, target_ms, quote, recv_ts_ms, round(realized, 6) AS realized FROM labels"),
        "j4_prompt_windows": _sql(WIN, "SELECT asset, current_time_ms, venue, seq FROM win"),
        "j5_depth_pairs": _sql("", f"SELECT asset, current_time_ms, arg_max(seq, recv_ts_ms) AS latest, arg_min(seq, (d, recv_ts_ms)) AS start, min(d) AS off_ms, min(d) <= {H} AS usable FROM (SELECT p.asset, p.t AS current_time_ms, s.seq, s.recv_ts_ms, abs(s.recv_ts_ms - (p.t - 6 * {H})) AS d FROM prompts p JOIN spot s ON s.asset = p.asset AND s.recv_ts_ms > p.t - 12 * {H} AND s.recv_ts_ms <= p.t) GROUP BY asset, current_time_ms"),
        "j6_horizon_pairs": _sql("", f"SELECT a.asset, a.seq AS start, b.seq AS \"end\", round(b.micro - a.micro, 6) AS move FROM spot a ASOF JOIN spot b ON a.asset = b.asset AND a.recv_ts_ms + 3 * {H} >= b.recv_ts_ms WHERE b.recv_ts_ms - a.recv_ts_ms >= 2 * {H}"),
        "j7_basis_grid": _sql("", "SELECT p.asset, p.t AS current_time_ms, round(f.mid - s.mid, 6) + 0.0::DOUBLE AS basis FROM prompts p ASOF LEFT JOIN spot s ON p.asset = s.asset AND p.t >= s.recv_ts_ms ASOF LEFT JOIN (SELECT * FROM quotes WHERE venue = 'futures') f ON p.asset = f.asset AND p.t >= f.recv_ts_ms"),
        "j8_season_lookup": _sql(CANDLES + SEASON, "SELECT asset, t AS current_time_ms, (((t // 600000 - 576) % 1008 + 1008) % 1008)::INT AS slot, round(seas_abs, 6) AS seas_abs FROM prompts LEFT JOIN seas ON seas.slot = ((t // 600000 - 576) % 1008 + 1008) % 1008"),
        "j9_prompt_model_grid": _sql(LABELS, "SELECT p.asset, p.current_time_ms, m.model, a.model IS NOT NULL AS answered FROM priced p CROSS JOIN models m LEFT JOIN answers a ON a.asset = p.asset AND a.current_time_ms = p.current_time_ms AND a.model = m.model"),
        "j10_eligible_models": _sql(SCORES + ", s AS (SELECT * FROM scores WHERE model <> 'm7' OR asset <> 'click' OR NOT answered)", "SELECT asset, model, count(*) AS n FROM s WHERE (asset, model) IN (SELECT (asset, model) FROM s WHERE answered) GROUP BY ALL"),
        "j11_missing_prompts": _sql(LABELS, f"SELECT asset, t AS current_time_ms FROM prompts p WHERE NOT EXISTS (SELECT 1 FROM priced x WHERE x.asset = p.asset AND x.current_time_ms = p.t AND x.current_time_ms // {H} % 3 = 0)"),
        "j12_near_identical_models": _sql(LABELS + ", med AS (SELECT asset, current_time_ms, model, (max(x) FILTER (WHERE i = 50) + max(x) FILTER (WHERE i = 51)) * 0.5 AS m FROM ladder GROUP BY ALL), wid AS (SELECT l.asset, l.current_time_ms, l.model, avg(abs(x - m)) AS w FROM ladder l JOIN med USING (asset, current_time_ms, model) GROUP BY ALL)", "SELECT a, b, count(*) AS n, round(avg(d), 6) AS distance FROM (SELECT l.model AS a, k.model AS b, l.asset, l.current_time_ms, avg(abs(l.x - k.x)) / (0.5 * (any_value(w1.w) + any_value(w2.w))) AS d FROM ladder l JOIN ladder k ON l.asset = k.asset AND l.current_time_ms = k.current_time_ms AND l.i = k.i AND l.model < k.model JOIN wid w1 ON w1.asset = l.asset AND w1.current_time_ms = l.current_time_ms AND w1.model = l.model JOIN wid w2 ON w2.asset = k.asset AND w2.current_time_ms = k.current_time_ms AND w2.model = k.model GROUP BY l.model, k.model, l.asset, l.current_time_ms) GROUP BY a, b HAVING avg(d) <= 0.6"),
        "a1_candles": _sql(CANDLES, "SELECT asset, venue, open_time_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM candles"),
        "a2_upsert_candles": _sql("", "SELECT asset, venue, ts_ms AS open_time_ms, max(seq) AS seq, arg_max(price, seq) AS price, arg_max(qty, seq) AS qty FROM ticks GROUP BY ALL"),
        "a3_trade_flow": _sql(WIN + ", b AS (SELECT *, row_number() OVER (PARTITION BY asset, venue, current_time_ms ORDER BY recv_ts_ms DESC, seq DESC) AS back, max(recv_ts_ms) OVER (PARTITION BY asset, venue, current_time_ms) AS newest FROM signed)", f"SELECT asset, venue, current_time_ms, round(sum(s) / sum(qty), 6) AS flow, round(sum(s) FILTER (WHERE back <= 5) / sum(qty) FILTER (WHERE back <= 5), 6) AS flow_fast, round(sum(s) FILTER (WHERE recv_ts_ms >= newest - 2 * {H}) / sum(qty) FILTER (WHERE recv_ts_ms >= newest - 2 * {H}), 6) AS flow_window, round(sum(qty) FILTER (WHERE recv_ts_ms >= newest - 2 * {H}), 6) AS qty_window FROM b GROUP BY ALL"),
        "a4_side_flow": _sql(WIN, f"SELECT asset, venue, current_time_ms, coalesce(sum(qty) FILTER (WHERE current_time_ms - recv_ts_ms < 2 * {H} AND NOT buyer_is_maker), 0) AS bought, coalesce(sum(qty) FILTER (WHERE current_time_ms - recv_ts_ms < 2 * {H} AND buyer_is_maker), 0) AS sold FROM win GROUP BY ALL"),
        "a5_depth_imbalance": _sql(LEVELS, "SELECT asset, venue, seq, round((sum(qty) FILTER (WHERE side = 'bid') - sum(qty) FILTER (WHERE side = 'ask')) / sum(qty), 6) AS obi, round((sum(qty) FILTER (WHERE side = 'bid' AND i < 5) - sum(qty) FILTER (WHERE side = 'ask' AND i < 5)) / sum(qty) FILTER (WHERE i < 5), 6) AS top_obi FROM lv GROUP BY ALL"),
        "a6_liquidation_signals": _sql("", f"SELECT asset, current_time_ms, round(tanh(coalesce(sum(CASE WHEN is_buy THEN qty ELSE -qty END) FILTER (WHERE recv_ts_ms >= current_time_ms - {H}), 0) / 10.0), 6) AS direction, round(tanh(sum(qty) / 100.0), 6) AS activity, count(*) AS n FROM (SELECT p.t AS current_time_ms, k.* FROM prompts p JOIN ticks k ON k.asset = p.asset AND k.asset = 'error' AND k.recv_ts_ms >= p.t - 6 * {H} AND k.recv_ts_ms <= p.t) GROUP BY ALL"),
        "a7_depth_bands": _sql(LEVELS + ", anchored AS (SELECT *, 0.5 * (max(price) FILTER (WHERE side = 'bid' AND i = 0) OVER (PARTITION BY seq) + max(price) FILTER (WHERE side = 'ask' AND i = 0) OVER (PARTITION BY seq)) AS anchor FROM lv), banded AS (SELECT *, CASE WHEN side = 'bid' THEN ceil((anchor - price) / 0.05::DOUBLE - 1e-9) - 1 ELSE floor((price - anchor) / 0.05::DOUBLE + 1e-9) END::INT AS band FROM anchored), per AS (SELECT asset, venue, seq, side, band, sum(qty) AS size FROM banded WHERE band BETWEEN 0 AND 99 GROUP BY ALL)", "SELECT asset, venue, side, band, sum(size) AS size, count(*) AS n FROM per GROUP BY ALL"),
        "a9_ewma_vol": _sql(CANDLES + AGED.format(cond="r_one IS NOT NULL"), "SELECT asset, venue, round(sqrt(sum(pow(0.94, age) * r_one * r_one) FILTER (WHERE age < 120) / sum(pow(0.94, age)) FILTER (WHERE age < 120)), 9) AS vol_slow, round(sqrt(sum(pow(0.85, age) * r_one * r_one) FILTER (WHERE age < 90) / sum(pow(0.85, age)) FILTER (WHERE age < 90)), 9) AS vol_fast FROM aged GROUP BY ALL"),
        "a10_book_volatility": _sql(f", w AS (SELECT p.t AS current_time_ms, k.asset, k.venue, k.recv_ts_ms, k.seq, k.micro, max(k.recv_ts_ms) OVER (PARTITION BY p.asset, k.venue, p.t) AS newest FROM prompts p JOIN quotes k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t), r AS (SELECT *, ln(micro / lag(micro) OVER (PARTITION BY asset, venue, current_time_ms ORDER BY recv_ts_ms, seq)) AS r FROM w WHERE recv_ts_ms > newest - 5 * {H}) SELECT asset, venue, current_time_ms, count(*) AS n, round(stddev_pop(r) * sqrt(count(r)), 6) AS rv, round(ln(max(micro) / min(micro)), 6) AS rng FROM r GROUP BY ALL HAVING count(*) >= 6"),
        "a10_thinned_volatility": _sql(THINNED, "SELECT asset, venue, t AS current_time_ms, count(*) AS n, round(stddev_pop(r) * sqrt(count(r)), 6) + 0.0::DOUBLE AS rv, round(ln(max(micro) / min(micro)), 6) + 0.0::DOUBLE AS rng FROM steps GROUP BY ALL HAVING count(*) >= 6"),
        "j6_window_pairs": _sql(PAIRS, "SELECT asset, current_time_ms, n_ticks, n_pairs, round(total, 6) + 0.0::DOUBLE AS total FROM kept"),
        "a14_window_offsets": _sql(PAIRS, "SELECT asset, current_time_ms, (i - 1)::INT AS i, round(quantile - middle, 9) + 0.0::DOUBLE AS offset FROM (SELECT asset, current_time_ms, unnest(range(1, 101)) AS i, unnest(list_aggregate(moves, 'quantile_cont', list_transform(range(1, 101), lambda x: (2 * x - 1) / 200.0::DOUBLE))) AS quantile, list_aggregate(moves, 'quantile_cont', 0.5) AS middle FROM kept)"),
        "a12_hour_stats": _sql(CANDLES + ", m AS (SELECT asset, venue, d_ten AS d, quantile_cont(d_ten, 0.5) OVER w AS median FROM moved WHERE d_ten IS NOT NULL WINDOW w AS (PARTITION BY asset, venue))", "SELECT asset, venue, count(*) AS n, round(any_value(median), 6) AS median, round(avg(abs(d - median)), 6) AS mad, round(CASE WHEN quantile_cont(abs(d), 0.5) > 1e-6 AND count(*) >= 50 THEN quantile_cont(abs(d), 0.99) / quantile_cont(abs(d), 0.5) ELSE 1e9 END, 6) AS jump_ratio FROM m GROUP BY ALL"),
        "a14_quantile_offsets": _sql(CANDLES + ", qs AS (SELECT asset, venue, quantile_cont(d_ten, 0.5) AS median, quantile_cont(d_ten, [" + ", ".join(f"{(2 * i - 1) / 200}" for i in range(1, 101)) + "]) AS q FROM moved WHERE d_ten IS NOT NULL GROUP BY ALL)", "SELECT asset, venue, i::INT AS i, round(v - median, 6) AS \"offset\" FROM (SELECT asset, venue, median, unnest(q) AS v, unnest(range(100)) AS i FROM qs)"),
        "a16_activity_ratio": _sql(CANDLES + AGED.format(cond="r_ten IS NOT NULL"), "SELECT asset, venue, round(ln((1e-6 + avg(abs(r_ten)) FILTER (WHERE age < 60)) / (1e-6 + avg(abs(r_ten)) FILTER (WHERE age < 480))), 6) AS activity FROM aged GROUP BY ALL"),
        "a17_pinball_crps": _sql(SCORES, "SELECT asset, current_time_ms, model, answered, round(crps, 6) AS crps FROM scores"),
        "a18_field_scores": _sql(SCORES, "SELECT asset, current_time_ms, model, round(field_score, 6) AS field_score FROM field"),
        "run_summary": _sql(SCORES, f"SELECT asset, model, {stats} FROM scores GROUP BY ALL"),
        "a19_exclusive_p95": _sql(SCORES + ", o AS (SELECT asset, model, crps, row_number() OVER (PARTITION BY asset, model ORDER BY crps) AS i, count(*) OVER (PARTITION BY asset, model) AS n FROM scores WHERE crps IS NOT NULL)", "SELECT asset, model, n, round(CASE WHEN n < 20 THEN max(crps) ELSE max(crps) FILTER (WHERE i = lo) + (0.95::DOUBLE * (n + 1) - any_value(lo)) * (max(crps) FILTER (WHERE i = lo + 1) - max(crps) FILTER (WHERE i = lo)) END, 6) AS percentile FROM (SELECT *, least(greatest(floor(0.95::DOUBLE * (n + 1)), 1), n - 1) AS lo FROM o) GROUP BY asset, model, n"),
        "a20_leaderboard": _sql(SCORES + "," + board, "SELECT asset, model, round(score, 6) AS score, n_prompts, rank::INT AS rank FROM ranked"),
        "q7_rank_models": _sql(SCORES + "," + board, "SELECT asset, model, round(score, 6) AS score, n_prompts, rank::INT AS rank, round(CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0 END * 1000.0 / (SELECT count(DISTINCT asset) FROM ranked), 6) AS reward FROM ranked"),
        "a21_reward_split": _sql(SCORES + "," + board, "SELECT asset, model, rank::INT AS rank, round(CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0 END * 1000.0 / (SELECT count(DISTINCT asset) FROM ranked), 6) AS reward FROM ranked"),
        "a22_rolling_crps": _sql(SCORES, f"SELECT asset, model, window_ms, count(*) AS n, round(avg(crps), 6) AS crps_mean FROM (SELECT asset, model, crps, unnest(range((current_time_ms // (6 * {H}) - 3) * 6 * {H}, current_time_ms // (6 * {H}) * 6 * {H} + 1, 6 * {H})) AS window_ms FROM scores WHERE crps IS NOT NULL) GROUP BY ALL HAVING count(*) >= 10"),
        "a23_split_eval": _sql(SCORES, "SELECT split, asset, count(*) AS n, round(avg(crps), 6) AS crps_mean FROM (SELECT *, CASE WHEN current_time_ms < 1705363200000 THEN 'fit' ELSE 'held' END AS split FROM scores WHERE crps IS NOT NULL) GROUP BY ROLLUP (split, asset)"),
        "a24_season_table": _sql(CANDLES + SEASON, "SELECT slot::INT AS slot, n, round(seas_abs, 6) AS seas_abs, round(seas_abs / usual, 6) AS seas_rel FROM seas LEFT JOIN usual ON slot // 6 % 24 = hour"),
        "a25_trigger_mix": _sql(ALL_PROMPTS, "SELECT asset, kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY asset), 6) AS share FROM built GROUP BY asset, kind"),
        "a26_tick_counts": _sql(WIN + COUNTS, "SELECT asset, venue, current_time_ms, n_1h, round(vol_1h, 9) AS vol_1h, flow_1h, round(range_1h, 9) AS range_1h, round(vwap_1h, 9) AS vwap_1h, n_6h, round(vol_6h, 9) AS vol_6h, flow_6h, round(range_6h, 9) AS range_6h, round(vwap_6h, 9) AS vwap_6h FROM counts"),
        "a31_robust_center_scale": _sql(WIN + COUNTS + ", long AS (SELECT venue, 'n' AS signal, n_6h::DOUBLE AS value FROM counts UNION ALL SELECT venue, 'flow', flow_6h FROM counts UNION ALL SELECT venue, 'range', range_6h FROM counts), c AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY venue, signal) AS centre FROM long)", "SELECT venue, signal, round(any_value(centre), 6) AS centre, round(avg(abs(value - centre)), 6) AS scale FROM c GROUP BY ALL"),
        "w1_gap_fill": _sql(CANDLES, "SELECT asset, venue, open_time_ms, round(close, 6) AS close, round(volume, 6) AS volume FROM filled"),
        "w2_lag_returns": _sql(CANDLES, "SELECT asset, venue, open_time_ms, " + ", ".join(f"round({k}_{n}, 6) AS {k}_{n}" for k in "rd" for n in ("one", "three", "ten")) + " FROM moved"),
        "w4_quote_ofi": _sql("", f", e AS (SELECT *, lag(bid_price) OVER w AS bp, lag(bid_qty) OVER w AS bq, lag(ask_price) OVER w AS ap, lag(ask_qty) OVER w AS aq FROM quotes WINDOW w AS (PARTITION BY asset, venue ORDER BY recv_ts_ms, seq)), f AS (SELECT *, CASE WHEN bp IS NULL THEN 0 WHEN bid_price > bp THEN bid_qty WHEN bid_price = bp THEN bid_qty - bq ELSE -bq END AS be, CASE WHEN ap IS NULL THEN 0 WHEN ask_price < ap THEN ask_qty WHEN ask_price = ap THEN ask_qty - aq ELSE -aq END AS ae FROM e) SELECT asset, venue, recv_ts_ms // {D} * {D} AS day_ms, round(sum(be - ae), 6) AS net, round(sum(abs(be) + abs(ae)), 6) AS gross, count(*) AS n FROM f GROUP BY ALL"),
        "w5_book_momentum": _sql("", f"SELECT asset, venue, seq, round(CASE WHEN a1 > 0 THEN ln(micro / a1) ELSE 0 END, 6) AS m1, round(CASE WHEN a3 > 0 THEN ln(micro / a3) ELSE 0 END, 6) AS m3 FROM (SELECT *, last_value(micro) OVER (PARTITION BY asset, venue ORDER BY recv_ts_ms RANGE BETWEEN {12 * H - 1} PRECEDING AND {H} PRECEDING) AS a1, last_value(micro) OVER (PARTITION BY asset, venue ORDER BY recv_ts_ms RANGE BETWEEN {12 * H - 1} PRECEDING AND {3 * H} PRECEDING) AS a3 FROM quotes)"),
        "w9_range_hold": _sql(CANDLES, "SELECT asset, venue, count(*) AS windows, round(avg(CASE WHEN hi - lo <= 4.0 THEN 1.0 ELSE 0.0 END), 6) AS held FROM (SELECT *, max(close) OVER w AS hi, min(close) OVER w AS lo, count(*) OVER w AS nth FROM filled WINDOW w AS (PARTITION BY asset, venue ORDER BY open_time_ms ROWS 10 PRECEDING)) WHERE nth = 11 GROUP BY ALL"),
        "w10_ewma_abs_return": _sql(CANDLES + AGED.format(cond="r_ten IS NOT NULL"), "SELECT asset, venue, round(sum(pow(0.98, age) * abs(r_ten)) / sum(pow(0.98, age)), 9) AS ewma_abs FROM aged WHERE age < 480 GROUP BY ALL"),
        "w11_vol_blend_inputs": _sql(CANDLES + AGED.format(cond="true"), "SELECT asset, venue, round(stddev_pop(r_one) * sqrt(10.0), 9) AS rv, round(ln(max(close) FILTER (WHERE age < 10) / min(close) FILTER (WHERE age < 10)), 9) AS range FROM aged WHERE age < 60 GROUP BY ALL"),
        "w12_trade_groups": _sql(GROUPS, "SELECT asset, venue, ts_ms, round(price, 6) AS price, recv_ts_ms, seq, n FROM groups"),
        "w13_price_moves": _sql(MOVES, "SELECT asset, venue, ts_ms, round(price, 6) AS price, round(reference, 6) AS reference, recv_ts_ms FROM moves"),
        "w14_sequence_gaps": _sql("", "SELECT seq, expected, prev_final_id FROM (SELECT seq, seq - 1 - (seq % 3 = 0)::INT AS prev_final_id, lag(seq) OVER (ORDER BY seq) AS expected FROM ticks) WHERE expected <> prev_final_id"),
        "w15_time_order": _sql("", "SELECT asset, venue, seq, at_ms, before_ms FROM (SELECT *, lag(at_ms) OVER (PARTITION BY asset, venue ORDER BY seq) AS before_ms FROM (SELECT asset, venue, seq, recv_ts_ms - seq % 5 * 6000000 AS at_ms FROM ticks)) WHERE at_ms < before_ms"),
        "q1_build_prompts": _sql(ALL_PROMPTS, "SELECT asset, current_time_ms, kind, venue FROM built"),
        "q8_anchor_grid": _sql("", f"SELECT unnest(range(min(recv_ts_ms), max(recv_ts_ms), 6 * {H})) AS anchor_ms FROM ticks"),
        "t2_last_closes": _sql(CANDLES, "SELECT asset, venue, open_time_ms, age::INT AS age, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY asset, venue ORDER BY open_time_ms DESC) - 1 AS age FROM candles) WHERE age < 24"),
        "t3_top_levels": _sql(LEVELS, "SELECT asset, venue, seq, side, (i + 1)::INT AS level, round(price, 6) AS price, qty FROM lv WHERE i < 3"),
        "t4_walk_the_book": _sql(LEVELS + ", walk AS (SELECT *, sum(price * qty) OVER (PARTITION BY seq, side ORDER BY i) AS total FROM lv), sides AS (SELECT asset, venue, seq, side, abs(coalesce(arg_min(price, i) FILTER (WHERE total >= 2000), arg_max(price, i)) - arg_min(price, i)) AS walk FROM walk GROUP BY ALL)", "SELECT asset, venue, seq, round(max(walk) FILTER (WHERE side = 'bid'), 6) AS bid_walk, round(max(walk) FILTER (WHERE side = 'ask'), 6) AS ask_walk, round(max(walk) FILTER (WHERE side = 'bid') - max(walk) FILTER (WHERE side = 'ask'), 6) AS gap FROM sides GROUP BY ALL"),
        "t5_replay_book": _sql(LEVELS + ", l2 AS (SELECT asset, venue, seq, side, round(price, 2) AS price, qty, seq // 50 AS block_ms, min(seq) OVER (PARTITION BY asset, venue, seq // 50) AS first FROM lv), d AS (SELECT *, CASE WHEN seq > first AND (qty + seq) % 4 = 0 THEN 0 ELSE qty END AS size FROM l2), book AS (SELECT asset, venue, block_ms, side, price, arg_max(size, seq) AS qty FROM d GROUP BY ALL)", "SELECT asset, venue, block_ms, side, count(*) AS n, sum(qty) AS qty FROM book WHERE qty > 0 GROUP BY ALL"),
        "t6_best_and_worst": _sql(SCORES + ", s AS (SELECT asset, model, current_time_ms, round(crps, 6) AS crps FROM scores WHERE crps IS NOT NULL), e AS (SELECT *, 'best' AS \"end\", row_number() OVER (PARTITION BY asset, model ORDER BY crps, current_time_ms) AS nth FROM s UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY asset, model ORDER BY crps DESC, current_time_ms) FROM s)", "SELECT asset, model, \"end\", nth::INT AS nth, current_time_ms, crps FROM e WHERE nth <= 3"),
        "u1_union_moves": _sql(MOVES, "SELECT asset, recv_ts_ms, venue, round(price, 6) AS price FROM moves"),
        "u3_ingest_merge": _sql(", stored AS (SELECT * FROM ticks WHERE seq % 3 <> 0 AND recv_ts_ms < 1705900000000), s AS (SELECT asset, venue, min(recv_ts_ms) AS lo, max(recv_ts_ms) AS hi FROM stored GROUP BY ALL)", "SELECT asset, venue, recv_ts_ms, seq, 'stored' AS origin FROM stored UNION ALL SELECT t.asset, t.venue, t.recv_ts_ms, t.seq, 'batch' FROM ticks t LEFT JOIN s ON s.asset = t.asset AND s.venue = t.venue WHERE s.lo IS NULL OR t.recv_ts_ms < lo OR t.recv_ts_ms > hi"),
        "u4_coverage_windows": _sql(CANDLES + ", w AS (SELECT DISTINCT asset, venue FROM candles), c AS (SELECT asset, venue, open_time_ms, lead(open_time_ms) OVER (PARTITION BY asset, venue ORDER BY open_time_ms) AS nxt FROM candles WHERE open_time_ms >= 1704067200000 AND open_time_ms < 1706918400000 AND (asset <> 'view' OR venue <> 'futures'))", f"SELECT * FROM (SELECT w.asset, w.venue, 1704067200000 AS from_ms, coalesce(min(open_time_ms), 1706918400000) AS to_ms FROM w LEFT JOIN c USING (asset, venue) GROUP BY ALL UNION ALL SELECT asset, venue, max(open_time_ms) + {H}, 1706918400000 FROM c GROUP BY asset, venue UNION ALL SELECT asset, venue, open_time_ms + {H}, nxt FROM c WHERE nxt IS NOT NULL) WHERE from_ms < to_ms"),
        "u5_common_prompts": _sql(LABELS, "SELECT asset, current_time_ms FROM answers GROUP BY ALL HAVING count(DISTINCT model) = 8"),
        "f1_clock_functions": _sql("", "SELECT seq, recv_ts_ms AS ms, strftime(make_timestamp(recv_ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS utc, recv_ts_ms + ((5000 - recv_ts_ms) % 20000 + 20000) % 20000 AS next_slot, CASE WHEN recv_ts_ms % 20000 >= 10250 AND recv_ts_ms % 20000 < 14250 THEN recv_ts_ms - recv_ts_ms % 20000 END AS event_slot, (((recv_ts_ms // 600000 - 576) % 1008 + 1008) % 1008)::INT AS season_slot FROM ticks"),
        "f15_event_coin": _sql("", f"SELECT seq, {COIN} < 0.5 AS taken, {DELAYED} AS delay_ms FROM ticks"),
        "f10_signal_scores": _sql(WIN + COUNTS + f", zs AS (SELECT *, {z} AS z, {z1} AS z1 FROM counts)", "SELECT asset, venue, current_time_ms, round(z, 6) AS z, round(z1, 6) AS z_log, round(1 / (1 + exp(-(0.2 + z * 1.5 + z1 * -0.7))), 6) AS p, round(exp(0.1 + 0.4 * ln(greatest(vol_6h, 1e-3)) + 0.3 * ln(greatest(range_6h, 1e-3))), 6) AS blend FROM zs"),
        "r1_ladders": _sql(LABELS + ", m AS (SELECT asset, current_time_ms, model, min(x) AS lo, max(x) AS hi, 0.5 * (max(x) FILTER (WHERE i = 50) + max(x) FILTER (WHERE i = 51)) AS median FROM ladder GROUP BY ALL)", "SELECT asset, current_time_ms, model, round(any_value(lo), 6) AS q_first, round(any_value(hi), 6) AS q_last, round(any_value(median), 6) AS median, round(avg(abs(x - median)), 6) AS width, 0 AS n_bad FROM ladder JOIN m USING (asset, current_time_ms, model) GROUP BY ALL"),
        "s2_normalized_trades": _sql("", "SELECT asset, venue, seq, ts_ms, recv_ts_ms AS event_ts_ms, recv_ts_ms, price, qty, buyer_is_maker FROM ticks WHERE seq % 7 <> 0 AND seq % 5 <> 0 AND seq % 97 <> 0 AND seq % 89 <> 0"),
        "s3_normalized_quotes": _sql("", "SELECT asset, venue, seq, recv_ts_ms, round(bid_price, 6) AS bid_price, bid_qty, round(ask_price, 6) AS ask_price, ask_qty, NULL::BIGINT AS event_ts_ms FROM quotes WHERE seq % 7 <> 0 AND seq % 5 = 0 AND seq % 97 <> 0 AND seq % 89 <> 0"),
        "s6_normalized_liquidations": _sql("", "SELECT asset, venue, seq, ts_ms, recv_ts_ms, price, qty, is_buy FROM ticks WHERE seq % 7 = 0 AND seq % 97 <> 0 AND seq % 89 <> 0"),
        "s12_score_report": _sql(SCORES, f"SELECT asset, model, row_number() OVER (PARTITION BY asset, model ORDER BY current_time_ms)::INT AS test, current_time_ms, strftime(make_timestamp(current_time_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS start, strftime(make_timestamp((current_time_ms + {H}) * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS target, '0.500' AS predict_ms, printf('%.6f', realized) AS realized, coalesce(printf('%.6f', crps), '') AS crps FROM scores JOIN (SELECT asset, current_time_ms, realized FROM labels) USING (asset, current_time_ms)"),
        "p7_forecast_violations": _sql(LABELS, f"SELECT asset, current_time_ms, model, CASE current_time_ms // {H} % 5 WHEN 1 THEN 'length' WHEN 2 THEN 'decreasing' WHEN 3 THEN 'not_positive,decreasing' ELSE '' END AS codes FROM answers"),
        "p8_determinism": _sql(LABELS, "SELECT asset, current_time_ms, model, 2 AS n_answers, model <> 'm3' AS same FROM answers"),
        "p10_asset_params": _sql("", "SELECT asset, name, CASE WHEN asset = 'click' AND name = 'REG_A' THEN 0.7 WHEN asset = 'view' AND name = 'WIDTH' THEN 1.2 WHEN name = 'REG_A' THEN 0.62 ELSE 1.0 END::DOUBLE AS value FROM (SELECT DISTINCT asset FROM ticks) CROSS JOIN (VALUES ('REG_A'), ('WIDTH')) v(name)"),
        "t1_latest_rows": _sql(WIN, "SELECT asset, venue, current_time_ms, arg_max(seq, recv_ts_ms) AS seq, arg_max(price, recv_ts_ms) AS price, max(recv_ts_ms) AS recv_ts_ms FROM win GROUP BY asset, venue, current_time_ms"),
        "w6_mid_change_lookback": _sql(f", fut AS (SELECT * FROM quotes WHERE venue = 'futures'), m AS (SELECT p.asset, p.t AS current_time_ms, s1.mid - s0.mid AS s, f1.mid - f0.mid AS f FROM prompts p ASOF LEFT JOIN spot s1 ON p.asset = s1.asset AND p.t >= s1.recv_ts_ms ASOF LEFT JOIN spot s0 ON p.asset = s0.asset AND p.t - 3 * {H} >= s0.recv_ts_ms ASOF LEFT JOIN fut f1 ON p.asset = f1.asset AND p.t >= f1.recv_ts_ms ASOF LEFT JOIN fut f0 ON p.asset = f0.asset AND p.t - 3 * {H} >= f0.recv_ts_ms)", "SELECT asset, current_time_ms, round(s, 6) + 0.0::DOUBLE AS schg, round(f, 6) + 0.0::DOUBLE AS fchg, round(f - s, 6) + 0.0::DOUBLE AS lead FROM m"),
        "w7_basis_deviation": _sql(", b AS (SELECT p.asset, p.t AS current_time_ms, round(f.mid - s.mid, 6) + 0.0::DOUBLE AS basis FROM prompts p ASOF JOIN spot s ON p.asset = s.asset AND p.t >= s.recv_ts_ms ASOF JOIN (SELECT * FROM quotes WHERE venue = 'futures') f ON p.asset = f.asset AND p.t >= f.recv_ts_ms)", f"SELECT asset, current_time_ms, round(basis - avg(basis) OVER (PARTITION BY asset ORDER BY current_time_ms RANGE BETWEEN {4 * H} PRECEDING AND CURRENT ROW), 6) + 0.0::DOUBLE AS bdev5, round(basis - avg(basis) OVER (PARTITION BY asset ORDER BY current_time_ms RANGE BETWEEN {14 * H} PRECEDING AND CURRENT ROW), 6) + 0.0::DOUBLE AS bdev15 FROM b"),
        "w16_prompt_spacing": _sql(ALL_PROMPTS, f"SELECT asset, current_time_ms // {H} * {H} AS slot, count(*) AS n FROM built WHERE kind = 'event' GROUP BY asset, current_time_ms // {H}"),
        "a8_band_imbalance": _sql(LEVELS + ", anchored AS (SELECT *, 0.5 * (max(price) FILTER (WHERE side = 'bid' AND i = 0) OVER (PARTITION BY seq) + max(price) FILTER (WHERE side = 'ask' AND i = 0) OVER (PARTITION BY seq)) AS anchor, max(price) FILTER (WHERE side = 'bid' AND i = 0) OVER (PARTITION BY seq) + 0.004::DOUBLE AS mid FROM lv), banded AS (SELECT *, CASE WHEN side = 'bid' THEN ceil((anchor - price) / 0.05::DOUBLE - 1e-9) - 1 ELSE floor((price - anchor) / 0.05::DOUBLE + 1e-9) END::INT AS band FROM anchored), per AS (SELECT asset, venue, seq, side, band, anchor, mid, sum(qty) AS size FROM banded WHERE band BETWEEN 0 AND 99 GROUP BY ALL), s AS (SELECT asset, venue, seq, coalesce(sum(size) FILTER (WHERE side = 'bid' AND anchor - band * 0.05::DOUBLE > mid - 0.1::DOUBLE AND anchor - (band + 1) * 0.05::DOUBLE < mid), 0) AS b, coalesce(sum(size) FILTER (WHERE side = 'ask' AND anchor + band * 0.05::DOUBLE < mid + 0.1::DOUBLE AND anchor + (band + 1) * 0.05::DOUBLE > mid), 0) AS a FROM per GROUP BY ALL)", "SELECT asset, venue, seq, round(CASE WHEN a + b > 0 THEN (b - a) / (a + b) ELSE 0 END, 6) + 0.0::DOUBLE AS band_imb FROM s"),
        "a30_liquidation_sums": _sql("", f"SELECT asset, current_time_ms, coalesce(sum(s) FILTER (WHERE age < {H}), 0) AS liq_signed_1h, count(*) FILTER (WHERE age < {H}) AS liq_n_1h, sum(s) AS liq_signed_6h, count(*) AS liq_n_6h FROM (SELECT p.t AS current_time_ms, k.asset, p.t - k.recv_ts_ms AS age, CASE WHEN is_buy THEN qty ELSE -qty END AS s FROM prompts p JOIN ticks k ON k.asset = p.asset AND k.asset = 'error' AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t) GROUP BY asset, current_time_ms"),
        "a32_touch_queue_ratio": _sql(f", f AS (SELECT p.asset, p.t, coalesce(sum(qty) FILTER (WHERE NOT buyer_is_maker), 0) AS bought, coalesce(sum(qty) FILTER (WHERE buyer_is_maker), 0) AS sold FROM prompts p JOIN spot k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t GROUP BY p.asset, p.t)", "SELECT f.asset, f.t AS current_time_ms, round(ln(1 + least(s.bid_qty, s.ask_qty)), 6) AS minq, round(least(ln((s.bid_qty + 0.001) / (sold + 0.05)), ln((s.ask_qty + 0.001) / (bought + 0.05))), 6) AS q_flow FROM f ASOF JOIN spot s ON f.asset = s.asset AND f.t >= s.recv_ts_ms"),
        "x1_stream_candles": _sql("", f"SELECT asset, venue, recv_ts_ms // {H} * {H} AS open_time_ms, round(arg_min(price, recv_ts_ms), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, recv_ts_ms), 6) AS close, round(sum(qty), 6) AS volume FROM ticks GROUP BY asset, venue, recv_ts_ms // {H}"),
        "q2_build_features": _sql(FEATURES, "SELECT asset, current_time_ms, stale_ms, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in FEATURE_NAMES) + " FROM feat"),
        "q4_build_signals": _sql(CANDLES + LEVELS + SIGNALS, SIGNALS_OUT),
        "p5_filter_depth_updates": _sql(f", u AS (SELECT asset, venue, recv_ts_ms, seq * 3 - 2 AS first_id, seq * 3 AS final_id, recv_ts_ms // {D} AS day FROM ticks), s AS (SELECT asset, venue, day, arg_min(final_id, recv_ts_ms) - 1 AS start_id, min(recv_ts_ms) AS t FROM u GROUP BY ALL)", f"SELECT u.asset, u.venue, first_id, final_id, start_id FROM u JOIN s ON u.asset = s.asset AND u.venue = s.venue AND u.day = s.day WHERE final_id >= start_id AND recv_ts_ms <= t + 8 * {H} AND (recv_ts_ms > t + {H} OR (recv_ts_ms > t + 1000 - 2000 AND first_id <= start_id + 1))"),
        "q5_assembled_payloads": _sql(f", n AS (SELECT p.asset, p.t, count(k.seq) FILTER (WHERE venue = 'spot') AS ts, count(k.seq) FILTER (WHERE venue = 'futures') AS tf, count(k.seq) FILTER (WHERE venue = 'spot' AND recv_ts_ms > p.t - 2 * {H}) AS qs, count(k.seq) FILTER (WHERE venue = 'futures' AND recv_ts_ms > p.t - 2 * {H}) AS qf, max(recv_ts_ms) FILTER (WHERE venue = 'spot') AS newest FROM prompts p LEFT JOIN ticks k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t GROUP BY p.asset, p.t), m AS (SELECT *, CASE WHEN t % (7 * {H}) = 0 THEN t - 3 * {H} ELSE t END AS c FROM n)", "SELECT asset, c AS current_time_ms, ts::INT AS n_trades_spot, tf::INT AS n_trades_futures, qs::INT AS n_quotes_spot, qf::INT AS n_quotes_futures, asset NOT IN ('click', 'error', 'purchase', 'view') AS bad_asset, coalesce(newest > c, false) AS ahead FROM m"),
        "q3_still_features": _sql(CANDLES + SEASON + STILL, STILL_OUT),
        "w8_mid_changes": _sql(", g AS (SELECT p.asset, p.t AS current_time_ms, round(f.mid - s.mid, 6) + 0.0::DOUBLE AS basis FROM prompts p ASOF JOIN spot s ON p.asset = s.asset AND p.t >= s.recv_ts_ms ASOF JOIN (SELECT * FROM quotes WHERE venue = 'futures') f ON p.asset = f.asset AND p.t >= f.recv_ts_ms), c AS (SELECT *, coalesce(basis <> lag(basis) OVER w, false)::INT AS changed, coalesce(basis = lag(basis, 5) OVER w, false) AS still FROM g WINDOW w AS (PARTITION BY asset ORDER BY current_time_ms))", "SELECT asset, current_time_ms, changed, sum(changed) OVER (w ROWS 9 PRECEDING)::BIGINT AS changes, still, current_time_ms - last_value(CASE WHEN changed = 1 THEN current_time_ms END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS since FROM c WINDOW w AS (PARTITION BY asset ORDER BY current_time_ms)"),
        "r5_blend_ladders": _sql(LABELS + ", med AS (SELECT asset, current_time_ms, model, (max(x) FILTER (WHERE i = 50) + max(x) FILTER (WHERE i = 51)) * 0.5 AS m FROM ladder GROUP BY ALL), wid AS (SELECT *, substr(model, 2)::INT AS no FROM (SELECT l.asset, l.current_time_ms, l.model, avg(abs(x - m)) AS w FROM ladder l JOIN med USING (asset, current_time_ms, model) GROUP BY ALL)), ws AS (SELECT a.asset, a.current_time_ms, a.model, b.model AS other, least(greatest(1.5 * greatest(0.9 - a.w / b.w, 0), 0), 0.6) AS w FROM wid a JOIN wid b ON a.asset = b.asset AND a.current_time_ms = b.current_time_ms AND a.no = (b.no + 4) % 8), v AS (SELECT ws.*, (1 - w) * a.x + w * b.x AS v FROM ws JOIN ladder a ON a.asset = ws.asset AND a.current_time_ms = ws.current_time_ms AND a.model = ws.model JOIN ladder b ON b.asset = ws.asset AND b.current_time_ms = ws.current_time_ms AND b.model = ws.other AND b.i = a.i)", "SELECT asset, current_time_ms, model, round(any_value(w), 6) AS weight, round(sum(v), 4) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high FROM v GROUP BY asset, current_time_ms, model"),
        "r9_point_mass": _sql(LABELS + ", xs AS (SELECT asset, current_time_ms, model, any_value(price) AS p, list(x ORDER BY i) AS xs, count(*) FILTER (WHERE x < price) / 100.0 * 0.75 AS below FROM ladder GROUP BY ALL), t AS (SELECT xs.*, tau, i, CASE WHEN tau < below THEN tau / 0.75 ELSE (tau - 0.25) / 0.75 END AS t FROM xs CROSS JOIN grid), a AS (SELECT *, least(greatest(t * 100 - 0.5, 0), 99) AS pos, least(floor(least(greatest(t * 100 - 0.5, 0), 99)), 98)::INT AS low FROM t), v AS (SELECT *, xs[low + 1] + (pos - low) * (xs[low + 2] - xs[low + 1]) AS m FROM a), o AS (SELECT *, CASE WHEN tau < below THEN least(m, p) WHEN tau > below + 0.25 THEN greatest(m, p) ELSE p END AS q FROM v)", "SELECT asset, current_time_ms, model, (count(*) FILTER (WHERE q = p))::INT AS n_atom, 0 AS n_bad, round(sum(q), 4) AS total, round(min(q), 6) AS low FROM o GROUP BY asset, current_time_ms, model"),
        "a15_weighted_bin_means": _sql(CANDLES + AGED.format(cond="r_ten IS NOT NULL") + ", p AS (SELECT asset, venue, abs(r_ten) AS v, max(age) OVER k - age + 1.0 AS w, age FROM aged WHERE age < 480 WINDOW k AS (PARTITION BY asset, venue)), c AS (SELECT *, w / sum(w) OVER k AS share, sum(w) OVER (k ORDER BY v, age DESC ROWS UNBOUNDED PRECEDING) / sum(w) OVER k AS hi FROM p WINDOW k AS (PARTITION BY asset, venue)), b AS (SELECT asset, venue, bin::INT AS bin, sum(v * greatest(least(hi, (bin + 1) / 20.0) - greatest(hi - share, bin / 20.0), 0)) * 20 AS m FROM c CROSS JOIN range(20) r(bin) GROUP BY ALL)", "SELECT asset, venue, bin, round(max(m) OVER (PARTITION BY asset, venue ORDER BY bin), 9) AS mean FROM b"),
        "r10_reshaped_ladders": _sql(LABELS + ", med AS (SELECT asset, current_time_ms, model, (max(x) FILTER (WHERE i = 50) + max(x) FILTER (WHERE i = 51)) * 0.5 AS m, (max(x) FILTER (WHERE i = 25) + max(x) FILTER (WHERE i = 26)) * 0.5 AS lo, (max(x) FILTER (WHERE i = 75) + max(x) FILTER (WHERE i = 76)) * 0.5 AS hi FROM ladder GROUP BY ALL), b AS (SELECT l.*, m, avg(abs(x - m)) OVER (PARTITION BY l.asset, l.current_time_ms, l.model) AS w, CASE WHEN i <= 11 OR i >= 90 OR i IN (50, 51) THEN 0 WHEN abs(tau - 0.5) <= 0.25 THEN abs(tau - 0.5) / 0.25 ELSE (0.4 - abs(tau - 0.5)) / 0.15 END * CASE WHEN i <= 50 THEN -0.08 * (m - lo) ELSE 0.08 * (hi - m) END AS push FROM ladder l JOIN med USING (asset, current_time_ms, model)), s AS (SELECT *, max(x + push) OVER (PARTITION BY asset, current_time_ms, model ORDER BY i) AS c, m + 1.25 * (x - m) AS d, x + 0.1 * w AS e FROM b)", "SELECT asset, current_time_ms, model, round(max(c) FILTER (WHERE i = 25), 6) AS centre_q25, round(max(d) FILTER (WHERE i = 25), 6) AS wide_q25, round(max(e) FILTER (WHERE i = 25), 6) AS moved_q25, round(avg(abs(c - m)), 6) AS centre_width, round(avg(abs(d - m)), 6) AS wide_width, round(avg(abs(x - m)), 6) AS moved_width FROM s GROUP BY asset, current_time_ms, model"),
    }
