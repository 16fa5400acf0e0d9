"""DuckDB SQL of the queries over files, streams and forecast steps."""

from __future__ import annotations

from tidemark.plans.sql import ALL_PROMPTS, CANDLES, DELAYED, FEATURE_NAMES, FEATURES, LABELS, LEVELS, MOVES, PAIRS, SCORES, SIGNALS, D, H, _sql

ALL_FEATURES = f""",
b5 AS (SELECT asset, current_time_ms, venue, arg_max(micro, recv_ts_ms) AS micro, arg_max(micro, recv_ts_ms) FILTER (WHERE recv_ts_ms <= newest - 5 * {H}) AS at5 FROM qw GROUP BY ALL),
m5 AS (SELECT asset, current_time_ms, max(ln(micro / at5)) FILTER (WHERE venue = 'spot') AS s_m5, max(ln(micro / at5)) FILTER (WHERE venue = 'futures') AS f_m5 FROM b5 GROUP BY ALL),
cm AS (SELECT *, open_time_ms + {H} AS end_ms, (open_time_ms - min(open_time_ms) OVER (PARTITION BY asset, venue)) // {H} + 1 >= 600 AS complete FROM moved),
ew AS (
  SELECT p.asset, p.t AS current_time_ms, venue, sqrt(sum(pow(0.94, a) * r_one * r_one) / sum(pow(0.94, a))) AS vol, sqrt(sum(pow(0.85, a) * r_one * r_one) FILTER (WHERE a < 12) / sum(pow(0.85, a)) FILTER (WHERE a < 12)) AS fast
  FROM (SELECT p.asset, p.t, c.venue, c.r_one, (p.t - c.end_ms) // {H} AS a FROM prompts p JOIN cm c ON c.asset = p.asset AND c.end_ms <= p.t AND c.end_ms > p.t - 24 * {H} WHERE r_one IS NOT NULL) p GROUP BY ALL
),
cs AS (SELECT p.asset, p.t, c.* EXCLUDE (asset) FROM prompts p ASOF JOIN (SELECT * FROM cm WHERE venue = 'spot') c ON p.asset = c.asset AND p.t >= c.end_ms),
cf AS (SELECT p.asset, p.t, c.* EXCLUDE (asset) FROM prompts p ASOF JOIN (SELECT * FROM cm WHERE venue = 'futures') c ON p.asset = c.asset AND p.t >= c.end_ms),
ts AS (SELECT p.asset, p.t, k.* EXCLUDE (asset, venue) FROM prompts p ASOF JOIN spot k ON p.asset = k.asset AND p.t >= k.recv_ts_ms),
tg AS (SELECT p.asset, p.t, k.price, k.recv_ts_ms FROM prompts p ASOF JOIN (SELECT * FROM quotes WHERE venue = 'futures') k ON p.asset = k.asset AND p.t >= k.recv_ts_ms),
parts AS (
  SELECT f.* EXCLUDE (price, mid, spread_rel), f.mid AS old_mid, pv.s_spread, pv.s_micro, pv.s_mid, pv.f_micro, pv.f_mid, cs.close AS s_close, cf.close AS f_close, coalesce(m5.s_m5, 0) AS s_m5, coalesce(m5.f_m5, 0) AS f_m5,
    CASE WHEN ts.recv_ts_ms > f.current_time_ms - 6 * {H} THEN ts.price END AS s_trade, CASE WHEN tg.recv_ts_ms > f.current_time_ms - 6 * {H} THEN tg.price END AS f_trade,
    ts.seq AS band_seq, ts.recv_ts_ms AS band_ms, ts.bid_price, ts.ask_price, coalesce(es.vol, 0) AS sv, coalesce(ef.vol, 0) AS fv, coalesce(es.fast, 0) AS vol_fast, coalesce(cs.r_one, 0) AS c1, coalesce(cs.r_three, 0) AS c3,
    coalesce(cs.r_ten, 0) AS s_mom, coalesce(cf.r_ten, 0) AS f_mom, coalesce(cs.complete, false) AS s_whole, coalesce(cf.complete, false) AS f_whole
  FROM feat f JOIN pv USING (asset, current_time_ms) LEFT JOIN m5 USING (asset, current_time_ms)
  LEFT JOIN cs ON cs.asset = f.asset AND cs.t = f.current_time_ms LEFT JOIN cf ON cf.asset = f.asset AND cf.t = f.current_time_ms
  LEFT JOIN ts ON ts.asset = f.asset AND ts.t = f.current_time_ms LEFT JOIN tg ON tg.asset = f.asset AND tg.t = f.current_time_ms
  LEFT JOIN ew es ON es.asset = f.asset AND es.current_time_ms = f.current_time_ms AND es.venue = 'spot' LEFT JOIN ew ef ON ef.asset = f.asset AND ef.current_time_ms = f.current_time_ms AND ef.venue = 'futures'
),
refs AS (
  SELECT *, coalesce(list_filter([s_micro, s_mid, f_micro, f_mid, s_close, f_close, s_trade, f_trade], lambda x: x > 0 AND coalesce(x / coalesce(s_close, f_close) BETWEEN 0.5 AND 2, true))[1], s_close, f_close, 1.0) AS price FROM parts
),
mids AS (SELECT *, coalesce(s_mid, price) AS mid, coalesce(s_spread / price, 0) AS spread_rel, 0.5 * (bid_price + ask_price) AS anchor, CASE WHEN f_whole THEN fv ELSE sv END AS fw FROM refs),
bl AS (
  SELECT m.asset, m.current_time_ms, anchor, mid, side, unnest(range(20)) AS i, bid_price, ask_price, band_seq FROM mids m CROSS JOIN (VALUES ('bid'), ('ask')) sides(side) WHERE band_ms >= current_time_ms - 4 * {H}
),
bb AS (
  SELECT asset, current_time_ms, side, anchor, mid, (1 + (band_seq + i) % 9)::DOUBLE AS qty,
    CASE WHEN side = 'bid' THEN ceil((anchor - (bid_price + i * -0.01::DOUBLE)) / 0.05::DOUBLE - 1e-9) - 1 ELSE floor((ask_price + i * 0.01::DOUBLE - anchor) / 0.05::DOUBLE + 1e-9) END::INT AS band FROM bl
),
bs AS (
  SELECT asset, current_time_ms, coalesce(sum(qty) FILTER (WHERE side = 'bid' AND anchor - band * 0.05::DOUBLE > mid - 0.1::DOUBLE AND anchor - (band + 1) * 0.05::DOUBLE < mid), 0) AS b,
    coalesce(sum(qty) FILTER (WHERE side = 'ask' AND anchor + band * 0.05::DOUBLE < mid + 0.1::DOUBLE AND anchor + (band + 1) * 0.05::DOUBLE > mid), 0) AS a FROM bb WHERE band BETWEEN 0 AND 99 GROUP BY ALL
),
whole AS (
  SELECT m.*, CASE WHEN fw > 0 THEN 0.6 * sv + 0.4 * fw ELSE sv END AS vol_1s, 0.5 * (s_mom + CASE WHEN f_whole THEN f_mom ELSE s_mom END) AS momentum, s_whole::INT::DOUBLE AS spot_complete, f_whole::INT::DOUBLE AS fut_complete,
    CASE WHEN coalesce(a + b, 0) > 0 THEN (b - a) / (a + b) ELSE 0 END AS band_imb, coalesce(s_trade, 0) AS s_last_trade
  FROM mids m LEFT JOIN bs USING (asset, current_time_ms)
)
"""
MORE_NAMES = ("s_m5", "f_m5", "vol_1s", "vol_fast", "momentum", "c1", "c3", "spot_complete", "fut_complete", "band_imb", "s_last_trade")
OFI = f""",
ev AS (SELECT *, lag(bid_price) OVER w AS bp, lag(bid_qty) OVER w AS bq, lag(ask_price) OVER w AS ap, lag(ask_qty) OVER w AS aq FROM quotes WINDOW w AS (PARTITION BY asset, venue ORDER BY recv_ts_ms, seq)),
es AS (
  SELECT *, CASE WHEN bp IS NULL THEN 0 WHEN bid_price > bp THEN bid_qty WHEN bid_price = bp THEN bid_qty - bq ELSE -bq END AS eb,
    CASE WHEN ap IS NULL THEN 0 WHEN ask_price < ap THEN ask_qty WHEN ask_price = ap THEN ask_qty - aq ELSE -aq END AS ea FROM ev
),
ow AS (
  SELECT p.asset, p.t AS current_time_ms, venue, eb, ea, recv_ts_ms >= max(recv_ts_ms) OVER w - 2 * {H} AND row_number() OVER (w ORDER BY recv_ts_ms, seq) > 1 AS latest
  FROM prompts p JOIN es k ON k.asset = p.asset AND k.recv_ts_ms > p.t - 6 * {H} AND k.recv_ts_ms <= p.t WINDOW w AS (PARTITION BY p.asset, p.t, venue)
),
os AS (SELECT asset, current_time_ms, venue, count(*) AS n, count(*) FILTER (WHERE latest) AS n_recent, sum(eb - ea) FILTER (WHERE latest) AS net, sum(abs(eb) + abs(ea)) FILTER (WHERE latest) AS gross FROM ow GROUP BY ALL)
"""
RUNS = """,
runs AS (SELECT *, (current_time_ms // 3600000 + substr(model, 2)::INT) % 13 <> 0 AS readable, 0.5::DOUBLE + (current_time_ms // 3600000 * 7 + substr(model, 2)::INT * 3) % 11 AS took FROM scores),
rs AS (
  SELECT asset, model, count(*) FILTER (WHERE readable) AS n, count(crps) FILTER (WHERE readable) AS n_scored, count(*) FILTER (WHERE NOT readable) AS n_unreadable, avg(crps) FILTER (WHERE readable) AS crps_mean,
    quantile_cont(took, 0.5) FILTER (WHERE readable) AS median_ms, max(took) FILTER (WHERE readable) AS max_ms, list(took ORDER BY took) FILTER (WHERE readable) AS all_ms FROM runs GROUP BY ALL
)
"""
#: What each fault of ``captures.p6_payload_rules`` breaks.
FAULTS = {1: "version", 2: "horizon", 3: "kind", 4: "trigger_venue", 5: "spot:symbol", 6: "spot:trades:time_order", 7: "spot:depth_latest:bids_order", 8: "futures:depth_start:times", 9: "spot:book_ticker:times", 10: "spot:liquidations:not_empty", 11: "spot:depth_bands:shape", 12: "spot:depth_bands:bucket", 13: "spot:complete_history", 14: "futures:depth_updates:ids", 15: "spot:trades:fields"}
#: The files of ``fixtures.payload_files``: a payload for each asset and day that has ticks.
SAVED = f""",
saved AS (
  SELECT asset, ts_ms // {D} * {D} + {D} AS folder_ms, count(*) FILTER (WHERE venue = 'spot') AS n, arg_min(price, seq) FILTER (WHERE venue = 'spot') AS price, arg_max(micro, seq) FILTER (WHERE venue = 'spot') AS micro
  FROM quotes GROUP BY ALL
)
"""
TRADE_MOVES = """,
nt AS (SELECT *, row_number() OVER (PARTITION BY asset, venue ORDER BY recv_ts_ms, seq) AS nth FROM ticks),
tf AS (
  SELECT asset, venue, nth, recv_ts_ms, seq, price, false AS move, price AS held FROM nt WHERE nth = 1
  UNION ALL
  SELECT n.asset, n.venue, n.nth, n.recv_ts_ms, n.seq, n.price, abs(n.price - f.held) / 0.5 > 1 + 1e-6, CASE WHEN abs(n.price - f.held) / 0.5 > 1 + 1e-6 THEN n.price ELSE f.held END
  FROM tf f JOIN nt n ON n.asset = f.asset AND n.venue = f.venue AND n.nth = f.nth + 1
)
"""
WIDTHS = """,
m0 AS (SELECT asset, venue, open_time_ms, d_one, d_ten, r_ten, volume, 0.5 + abs(d_one) / 4 AS w0, abs(d_ten) / 3 AS rec FROM moved WHERE r_ten IS NOT NULL),
m1 AS (SELECT *, CASE WHEN w0 > 0 AND rec > w0 THEN w0 * pow(rec / w0, 0.8) ELSE w0 END AS w1 FROM m0),
m2 AS (SELECT *, w1 * (1 + 0.3 * greatest(volume / 10, 0)) AS w2 FROM m1),
m3 AS (SELECT *, CASE WHEN w2 > 0 AND rec > 0 THEN w2 * least(greatest(0.62 + 0.38 * rec / w2, 0.62), 1) ELSE w2 END AS w3 FROM m2),
m4 AS (SELECT *, CASE WHEN w3 > 0 AND rec > 0 THEN d_one / 2 * least(greatest(1 - 0.5 * greatest(abs(d_one / 2) / w3 - 0.2, 0) / least(greatest(rec / w3, 0.5), 2.0), 0.4), 1) ELSE d_one / 2 END AS sh,
         CASE WHEN w3 > 0 AND rec > 0 THEN w3 * least(greatest(sqrt(rec / w3), 0.6), 1) ELSE w3 END AS w4 FROM m3),
m5 AS (SELECT *, CASE WHEN w4 > 0 THEN w4 * exp(least(greatest(0.25 * (ln(0.8) - ln(w4)), -0.2), 0.2)) ELSE w4 END AS w5 FROM m4)
"""
MED = ", med AS (SELECT asset, current_time_ms, model, any_value(price) AS p, (max(x) FILTER (WHERE i = 50) + max(x) FILTER (WHERE i = 51)) * 0.5 AS m FROM ladder GROUP BY ALL), wid AS (SELECT l.asset, l.current_time_ms, l.model, avg(abs(x - m)) AS w FROM ladder l JOIN med USING (asset, current_time_ms, model) GROUP BY ALL)"
Z6 = "CASE WHEN {v} IS NOT NULL THEN least(greatest(({v} - {c}) / {d}, -6.0), 6.0) / 3 END"


#: Rows of each stream's lifetime at every prompt and venue.
RETAINED = f""",
asked AS (SELECT asset, t, unnest(['spot', 'futures']) AS venue FROM prompts),
held AS (
  SELECT p.asset, p.venue, p.t AS current_time_ms,
    count(k.seq) FILTER (WHERE k.recv_ts_ms > p.t - 2 * {H}) AS n_trades, coalesce(sum(k.qty) FILTER (WHERE k.recv_ts_ms > p.t - 2 * {H}), 0) AS size_trades,
    count(k.seq) FILTER (WHERE k.recv_ts_ms > p.t - 5 * {H}) AS n_quotes, coalesce(sum(k.bid_qty) FILTER (WHERE k.recv_ts_ms > p.t - 5 * {H}), 0) AS size_quotes,
    count(k.seq) FILTER (WHERE k.asset = 'error') AS n_liquidations, coalesce(sum(k.qty) FILTER (WHERE k.asset = 'error'), 0) AS size_liquidations
  FROM asked p LEFT JOIN quotes k ON k.asset = p.asset AND k.venue = p.venue AND k.recv_ts_ms > p.t - 48 * {H} AND k.recv_ts_ms <= p.t
  GROUP BY ALL
)
"""

#: The 120 spot bars before each prompt: moves over ten, slices of recency weight, deviations and ratios.
HOURS = f""",
b AS (SELECT p.asset, p.t, f.close, row_number() OVER w AS i, count(*) OVER (PARTITION BY p.asset, p.t) AS n FROM prompts p JOIN filled f ON f.asset = p.asset AND f.venue = 'spot' AND f.open_time_ms + {H} > p.t - 120 * {H} AND f.open_time_ms + {H} <= p.t WINDOW w AS (PARTITION BY p.asset, p.t ORDER BY f.open_time_ms)),
s AS (SELECT *, n - i AS back, ln(close / lag(close, 10) OVER w) AS m, close - lag(close, 10) OVER w AS d, ln(close / lag(close) OVER w) AS one FROM b WINDOW w AS (PARTITION BY asset, t ORDER BY i)),
o AS (SELECT *, median(m) OVER (PARTITION BY asset, t) AS mid FROM s),
agg AS (
  SELECT asset, t, any_value(n) AS n, avg(abs(m - mid)) AS mad, sum(pow(0.98, back) * abs(m)) / sum(pow(0.98, back)) FILTER (WHERE m IS NOT NULL) AS ewma,
    CASE WHEN any_value(n) > 60 THEN stddev_pop(one) FILTER (WHERE back < 60) * sqrt(10) END AS rv, ln(max(close) FILTER (WHERE back < 10) / min(close) FILTER (WHERE back < 10)) AS rng,
    CASE WHEN any_value(n) >= 50 AND median(abs(d)) > 1e-6 THEN quantile_cont(abs(d), 0.99) / median(abs(d)) ELSE 1e9 END AS jump_ratio,
    CASE WHEN any_value(n) >= 30 THEN quantile_cont(abs(m), 0.9) FILTER (WHERE back < 90) END AS p90,
    CASE WHEN any_value(n) >= 30 THEN CASE WHEN count(m) >= 20 THEN ln((1e-6 + avg(abs(m)) FILTER (WHERE back < 20)) / (1e-6 + avg(abs(m)) FILTER (WHERE back < 90))) ELSE 0 END END AS activity
  FROM o GROUP BY ALL HAVING any_value(n) > 10
),
half AS (SELECT asset, t, abs(m) AS v, (row_number() OVER (PARTITION BY asset, t ORDER BY i))::DOUBLE AS w FROM s WHERE m IS NOT NULL AND back < 90 AND n >= 30),
mass AS (SELECT asset, t, v, w / sum(w) OVER (PARTITION BY asset, t) AS w, sum(w) OVER (PARTITION BY asset, t ORDER BY v, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY asset, t) AS upto FROM half),
slices AS (SELECT asset, t, k, 50 * sum(v * greatest(least(upto, (k + 1) / 50.0::DOUBLE) - greatest(upto - w, k / 50.0::DOUBLE), 0)) AS mean FROM mass CROSS JOIN range(50) g(k) GROUP BY ALL),
rising AS (SELECT asset, t, k, max(mean) OVER (PARTITION BY asset, t ORDER BY k) AS mean FROM slices)
"""

#: Quantiles of .85 Laplace(1) + .15 Laplace(3): sixty halvings of each level below a half, and their mirror.
MIXTURE = f""",
halving(i, tau, lo, hi, step) AS (
  SELECT i, tau, -30.0::DOUBLE, 0.0::DOUBLE, 0 FROM grid WHERE i <= 50
  UNION ALL
  SELECT i, tau, CASE WHEN 0.5 * (0.85 * exp((lo + hi) / 2) + 0.15 * exp((lo + hi) / 6)) < tau THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN 0.5 * (0.85 * exp((lo + hi) / 2) + 0.15 * exp((lo + hi) / 6)) < tau THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM halving WHERE step < 70
),
mz AS (SELECT i, (lo + hi) / 2 AS mz FROM halving WHERE step = 70 UNION ALL SELECT 101 - i, -(lo + hi) / 2 FROM halving WHERE step = 70),
mixed AS (SELECT asset, current_time_ms, i, price + 0.05::DOUBLE + (0.2::DOUBLE + current_time_ms // {H} % 9 / 10.0::DOUBLE) * mz AS x FROM priced CROSS JOIN mz),
middle AS (SELECT asset, current_time_ms, 0.5 * (max(x) FILTER (WHERE i = 50) + max(x) FILTER (WHERE i = 51)) AS m FROM mixed GROUP BY ALL)
"""

#: A point at the price of mass .1 to .8, and the ladder moved off it, widened and hollowed.
STILL = """,
mid AS (SELECT asset, current_time_ms, model, any_value(price) AS px, any_value(model_no) * 0.1::DOUBLE + 0.1::DOUBLE AS p, 0.5 * (max(x) FILTER (WHERE i = 50) + max(x) FILTER (WHERE i = 51)) AS m FROM ladder GROUP BY ALL),
wide AS (SELECT asset, current_time_ms, model, avg(abs(x - m)) * 0.2::DOUBLE AS h FROM ladder JOIN mid USING (asset, current_time_ms, model) GROUP BY ALL),
moved1 AS (
  SELECT l.asset, l.current_time_ms, l.model, i, tau, px, p, h, x + 0.3::DOUBLE * p / (1 - p) * (m - px) AS a, m + 0.3::DOUBLE * p / (1 - p) * (m - px) AS m1
  FROM ladder l JOIN mid USING (asset, current_time_ms, model) JOIN wide USING (asset, current_time_ms, model)
),
moved2 AS (SELECT *, a + 0.5::DOUBLE * p * (a - m1) AS b FROM moved1),
hollow AS (SELECT *, px + sign(b - px) * (abs(b - px) + h * (1 - exp(-abs(b - px) / h))) AS r FROM moved2),
rows AS (SELECT asset, current_time_ms, model, any_value(px) AS px, any_value(p) AS p, list(r ORDER BY i) AS xs, (count(*) FILTER (WHERE r < px))::INT AS k FROM hollow GROUP BY ALL),
lefts AS (
  SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = 100 THEN 1 ELSE (2 * k - 1) / 200.0::DOUBLE + least(greatest((px - xs[k]) / (xs[k + 1] - xs[k]), 0), 1) / 100.0::DOUBLE END AS l FROM rows
),
levels AS (SELECT f.*, i, tau, (1 - p) * l AS t1, CASE WHEN tau < (1 - p) * l THEN tau / (1 - p) ELSE (tau - p) / (1 - p) END AS t FROM lefts f CROSS JOIN grid),
places AS (SELECT *, least(greatest(t * 100 - 0.5, 0), 99) AS pos, least(floor(least(greatest(t * 100 - 0.5, 0), 99)), 98)::INT AS low FROM levels),
raw AS (SELECT *, CASE WHEN tau >= t1 AND tau <= t1 + p THEN px ELSE xs[low + 1] * (1 - (pos - low)) + xs[low + 2] * (pos - low) END AS v FROM places),
still AS (SELECT asset, current_time_ms, model, i, px, max(v) OVER (PARTITION BY asset, current_time_ms, model ORDER BY i) AS v FROM raw)
"""

#: What a prompt sees of each stream: sizes, the pair of snapshots, the diffs that go on from it, bands, and what is missing.
WHOLE = f""",
asked AS (SELECT asset, t, unnest(['spot', 'futures']) AS venue FROM prompts),
seen AS (SELECT a.*, k.seq, k.recv_ts_ms AS ms, abs(k.recv_ts_ms - (a.t - 12 * {H})) AS off FROM asked a LEFT JOIN ticks k ON k.asset = a.asset AND k.venue = a.venue AND k.recv_ts_ms > a.t - 48 * {H} AND k.recv_ts_ms <= a.t),
pair AS (
  SELECT asset, t, venue, count(seq) FILTER (WHERE ms > t - 6 * {H}) AS n, count(seq) FILTER (WHERE asset = 'error' AND venue = 'futures') AS liq,
    max(seq * 3 - 1) FILTER (WHERE ms > t - 24 * {H}) AS latest, arg_min(seq * 3 - 1, off * 1000000 + seq) FILTER (WHERE ms > t - 24 * {H}) AS near,
    arg_min(ms, off * 1000000 + seq) FILTER (WHERE ms > t - 24 * {H}) AS near_ms, min(off) FILTER (WHERE ms > t - 24 * {H}) AS off, max(seq) FILTER (WHERE ms > t - 6 * {H}) AS band_seq
  FROM seen GROUP BY ALL
),
started AS (SELECT * EXCLUDE (near), CASE WHEN off <= 4 * {H} THEN near END AS start FROM pair),
diffs AS (
  SELECT s.asset, s.t, s.venue, count(k.seq) AS n FROM started s LEFT JOIN seen k ON k.asset = s.asset AND k.t = s.t AND k.venue = s.venue AND k.ms > s.t - 24 * {H} AND k.seq * 3 >= s.start
    AND (k.ms > s.t - 12 * {H} OR (k.ms > s.near_ms - 6 * {H} AND k.seq * 3 - 2 <= s.start + 1)) GROUP BY ALL
),
cs AS (SELECT a.asset, a.t, a.venue, count(f.open_time_ms) AS n, max(f.open_time_ms) - min(f.open_time_ms) AS span FROM asked a LEFT JOIN filled f ON f.asset = a.asset AND f.venue = a.venue AND f.open_time_ms + {H} > a.t - 48 * {H} AND f.open_time_ms + {H} <= a.t GROUP BY ALL),
bands AS (
  SELECT l.seq, sum(l.qty) AS size FROM lv l JOIN quotes q USING (seq) WHERE l.side = 'bid' AND ceil((q.mid - l.price) / 0.05::DOUBLE - 1e-9) - 1 BETWEEN 0 AND 99 GROUP BY ALL
),
per AS (SELECT s.*, d.n AS updates, c.n AS bars, coalesce(c.n >= 48 AND c.span >= 47 * {H}, false) AS complete FROM started s JOIN diffs d USING (asset, t, venue) JOIN cs c USING (asset, t, venue)),
whole AS (
  SELECT s.asset, s.t AS current_time_ms, s.bars AS spot_candles_1s, s.n AS spot_trades, s.n AS spot_book_ticker, 0 AS spot_liquidations, s.updates AS spot_depth_updates,
    f.bars AS futures_candles_1s, f.n AS futures_trades, f.n AS futures_book_ticker, f.liq AS futures_liquidations, f.updates AS futures_depth_updates,
    s.start AS spot_depth_start, s.latest AS spot_depth_latest, f.start AS futures_depth_start, f.latest AS futures_depth_latest, s.complete, round(coalesce(b.size, 0), 6) AS bid_bands,
    concat_ws(',', CASE WHEN s.start IS NULL THEN 'spot:depth_start:missing' END, CASE WHEN s.latest IS NULL THEN 'spot:depth_latest:missing' END,
      CASE WHEN f.start IS NULL THEN 'futures:depth_start:missing' END, CASE WHEN f.latest IS NULL THEN 'futures:depth_latest:missing' END) AS codes
  FROM per s JOIN per f ON s.asset = f.asset AND s.t = f.t AND s.venue = 'spot' AND f.venue = 'futures' LEFT JOIN bands b ON b.seq = s.band_seq
)
"""

#: The last snapshot of each six hours, every fourth of them, by bands round its mid.
BAND_SAMPLES = f""",
lasts AS (SELECT asset, venue, recv_ts_ms // (6 * {H}) * 6 * {H} AS from_ms, arg_max(seq, recv_ts_ms) AS seq FROM ticks GROUP BY ALL),
due AS (SELECT * FROM lasts WHERE from_ms % (24 * {H}) = 0),
levels AS (SELECT d.asset, d.venue, d.from_ms, l.side, l.price, l.qty, q.mid FROM due d JOIN lv l USING (seq) JOIN quotes q USING (seq)),
placed AS (
  SELECT *, CASE WHEN side = 'bid' THEN ceil((mid - price) / 0.05::DOUBLE - 1e-9) - 1 ELSE floor((price - mid) / 0.05::DOUBLE + 1e-9) END::INT AS band FROM levels
)
"""


def oracle_sql() -> dict[str, str]:
    no = f"(current_time_ms // {H})"
    return {
        "s4_depth_updates": _sql("", "SELECT asset, venue, seq, recv_ts_ms AS event_ts_ms, seq * 2 - 1 AS first_id, seq * 2 AS final_id, CASE WHEN venue = 'futures' THEN seq * 2 - 2 ELSE coalesce(lag(seq * 2) OVER (PARTITION BY asset, venue ORDER BY seq), seq * 2 - 2) END AS prev_final_id, 2 AS n_bids, round(bid_price + 1, 6) AS second_bid, ask_qty FROM quotes"),
        "s5_klines": _sql(CANDLES, "SELECT asset, venue, open_time_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, true AS closed FROM candles"),
        "s7_payloads": _sql(SAVED, "SELECT asset, folder_ms, 5 AS schema_version, 1 AS n_updates, 0 AS n_liquidations, false AS corrupt FROM saved"),
        "s8_payloads_for_scoring": _sql(SAVED, "SELECT asset, folder_ms, false AS has_updates, round(price, 6) AS price, n AS n_quotes FROM saved"),
        "s9_saved_pairs": _sql(SAVED, f"SELECT asset, folder_ms, folder_ms // {D} % 7 <> 0 AS readable, CASE WHEN folder_ms // {D} % 7 <> 0 THEN round(micro, 6) END AS micro, n AS n_trades FROM saved WHERE folder_ms // {D} % 5 <> 0 AND n > 0"),
        "s10_exploded_payloads": _sql(", placed AS (SELECT *, (row_number() OVER (PARTITION BY asset, venue, ts_ms // 86400000 ORDER BY seq) - 1)::INT AS i FROM quotes)", f"SELECT asset, ts_ms // {D} * {D} + {D} AS current_time_ms, venue, i AS seq, 'trade' AS stream, round(price, 6) AS price FROM placed UNION ALL SELECT asset, ts_ms // {D} * {D} + {D}, venue, i, 'quote', round(bid_price, 6) FROM placed WHERE venue = 'spot'"),
        "s11_written_payloads": _sql(SAVED, "SELECT asset, folder_ms AS current_time_ms, n AS n_trades, 5 AS schema_version FROM saved"),
        "s13_trades_csv": _sql("", "SELECT seq, recv_ts_ms AS ts_ms, round(price, 6) AS price, qty, buyer_is_maker FROM ticks"),
        "s14_depth_csv": _sql("", "SELECT recv_ts_ms, seq AS update_id, 20 AS n_bids, round(bid_price, 6) AS bid, round(ask_price + 0.19::DOUBLE, 6) AS last_ask, true AS no_event FROM quotes"),
        "s15_kline_archive": _sql(CANDLES, "SELECT open_time_ms, count(*) * 2 AS n, round(sum(close) * 2, 4) AS close, round(max(high), 6) AS high FROM candles GROUP BY open_time_ms"),
        "s16_book_depth_archive": _sql(", s AS (SELECT recv_ts_ms - recv_ts_ms % 1000 AS recv_ts_ms, price, qty FROM ticks)", "SELECT recv_ts_ms, 2 * count(*)::INT AS n_bids, round(min(price) - 1, 6) AS bid, round(min(price) + 1, 6) AS ask FROM s GROUP BY recv_ts_ms"),
        "s17_book_ticker_archive": _sql("", "SELECT seq AS update_id, recv_ts_ms + 7 AS recv_ts_ms, recv_ts_ms AS transaction_ts_ms, round(bid_price, 6) AS bid_price, ask_qty FROM quotes"),
        "s18_kept_captures": _sql("", "SELECT recv_ts_ms::VARCHAR AS folder FROM ticks WHERE seq % 13 <> 0 AND recv_ts_ms >= 1706000000000 - 7 * 86400000"),
        "f7_tick_sizes": _sql("", "SELECT seq, CASE WHEN seq % 3 = 0 THEN (seq % 9 + 1) / 100.0 ELSE 0.5 END::DOUBLE AS tick FROM ticks"),
        "f8_candle_quotes": _sql(CANDLES, "SELECT asset, venue, open_time_ms, round(close - 0.1::DOUBLE, 6) AS bid_price, round(close + 0.1::DOUBLE, 6) AS ask_price, 2.0 AS ask_qty FROM candles"),
        "f13_widths": _sql(CANDLES + WIDTHS, "SELECT asset, venue, open_time_ms, round(w1, 6) AS blended, round(w2, 6) AS liquidation, round(w3, 6) AS regime, round(w4, 6) AS flexed, round(w5, 6) AS season, round(sh, 6) + 0.0::DOUBLE AS shift FROM m5"),
        "r6_mirrored_bins": _sql(LABELS + f", d AS (SELECT asset, current_time_ms, price, least(greatest(({no} % 7 * 1e-3 - 3e-3) / (25.5 * 1e-4), -1), 1) AS t FROM priced)", "SELECT asset, current_time_ms, 100 AS n, round(price * exp(-50 * 1e-4 * (1 - t)), 6) AS low, round(price * exp(50 * 1e-4 * (1 + t)), 6) AS high, round(0.5 * (price * exp(-1e-4 * (1 - t)) + price * exp(1e-4 * (1 + t))), 6) AS median FROM d"),
        "r7_mixed_ladders": _sql(
            LABELS + ", mx AS (SELECT asset, current_time_ms, model, x, 0.007::DOUBLE AS w, 0 AS side FROM ladder UNION ALL SELECT asset, current_time_ms, 'm' || (model_no + 4) % 8, x, 0.003::DOUBLE, 1 FROM ladder), "
            "ok AS (SELECT asset, current_time_ms, model FROM mx GROUP BY ALL HAVING count(*) = 200), c AS (SELECT *, sum(w) OVER (PARTITION BY asset, current_time_ms, model ORDER BY x, side ROWS UNBOUNDED PRECEDING) AS hi FROM mx JOIN ok USING (asset, current_time_ms, model)), "
            "qs AS (SELECT asset, current_time_ms, model, tau, min(x) FILTER (WHERE hi >= tau - 1e-9) AS v FROM c CROSS JOIN grid GROUP BY ALL)",
            "SELECT asset, current_time_ms, model, round(min(v), 6) AS low, round(max(v), 6) AS high, round(sum(v), 4) AS total FROM qs GROUP BY asset, current_time_ms, model",
        ),
        "r8_candle_weights": _sql(CANDLES + ", z AS (SELECT *, (abs(d_ten) - 1.2) / 0.4 + 0.7 * r_ten * 10 AS z FROM moved WHERE d_ten IS NOT NULL)", f"SELECT asset, venue, open_time_ms, round(CASE WHEN open_time_ms // {H} % 5 = 0 THEN 0 WHEN z >= 20 THEN 0 WHEN z <= -20 THEN 1 ELSE 1 / (1 + exp(z)) END, 6) AS weight FROM z"),
        "r11_live_widths": _sql(LABELS + MED + f", r AS (SELECT *, CASE WHEN {no} % 6 > 0 THEN 0.3::DOUBLE + {no} % 6 * 0.2::DOUBLE END AS recent FROM wid), f AS (SELECT *, least(greatest(sqrt(recent / w), 0.7), 1.4) AS f FROM r), g AS (SELECT *, CASE WHEN recent > 0 AND w >= 0.25 AND abs(f - 1) >= 1e-4 THEN f ELSE 1 END AS factor FROM f)", "SELECT asset, current_time_ms, model, round(factor, 6) AS factor, round(w * factor, 6) AS width FROM g"),
        "r12_trade_anchors": _sql(LABELS + f", s AS (SELECT *, CASE WHEN abs(x - price) > 0.05 THEN x + 0.4::DOUBLE * ({no} % 3 - 1) ELSE x END AS y FROM ladder), o AS (SELECT *, row_number() OVER (PARTITION BY asset, current_time_ms, model ORDER BY y) AS k FROM s)", "SELECT asset, current_time_ms, model, round(min(y), 6) AS low, round(0.5 * (max(y) FILTER (WHERE k = 50) + max(y) FILTER (WHERE k = 51)), 6) AS median, round(sum(y), 4) AS total FROM o GROUP BY asset, current_time_ms, model"),
        "r13_layer_terms": _sql(CANDLES + LEVELS + SIGNALS + LABELS + f", k AS (SELECT asset, current_time_ms, 0.05 * coalesce({Z6.format(v='schg5000', c='0.0', d='1.5')}, 0) + 0.02 * coalesce(s_dimb3, 0) AS shift, exp(least(greatest(0.1 * coalesce({Z6.format(v='ln(1 + s_nbt60000)', c='1.5', d='0.7')}, 0) + 0.2 * coalesce({Z6.format(v='c_mad60', c='1.0', d='0.8')}, 0), -1.5), 1.5)) AS scale FROM wide), y AS (SELECT l.asset, l.current_time_ms, l.model, shift, scale, CASE WHEN abs(x - price) > 0.005 THEN price + scale * (x - price) + shift ELSE x END AS y FROM ladder l JOIN k ON k.asset = l.asset AND k.current_time_ms = l.current_time_ms)", "SELECT asset, current_time_ms, model, round(any_value(shift), 6) + 0.0::DOUBLE AS shift, round(any_value(scale), 6) AS scale, round(min(y), 6) AS low, round(max(y), 6) AS high FROM y GROUP BY asset, current_time_ms, model"),
        "x2_stream_moves": _sql(TRADE_MOVES, "SELECT asset, venue, recv_ts_ms, seq, round(price, 6) AS price FROM tf WHERE move"),
        "x3_stream_event_prompts": _sql(ALL_PROMPTS, "SELECT asset, current_time_ms, venue, slot FROM (SELECT asset, recv_ts_ms + " + DELAYED + " AS current_time_ms, venue, slot FROM taken QUALIFY row_number() OVER (PARTITION BY asset, slot ORDER BY recv_ts_ms, venue, seq) = 1)"),
        "x4_stream_labels": _sql(LABELS, "SELECT asset, current_time_ms, quote AS seq, recv_ts_ms FROM labels"),
        "x6_depth_samples": _sql("", f"SELECT asset, venue, recv_ts_ms // (6 * {H}) * 6 * {H} AS from_ms, arg_max(seq, recv_ts_ms) AS update_id FROM ticks GROUP BY ALL"),
        "x2_group_moves": _sql(MOVES, "SELECT asset, venue, ts_ms, round(price, 6) AS price, round(reference, 6) AS reference, recv_ts_ms FROM moves"),
        "x5_retention": _sql(RETAINED, "SELECT asset, venue, current_time_ms, n_trades, size_trades, n_quotes, size_quotes, n_liquidations, size_liquidations FROM held"),
        "x6_band_samples": _sql(LEVELS + BAND_SAMPLES, "SELECT asset, venue, from_ms, side, band, round(sum(qty), 6) AS size FROM placed WHERE band BETWEEN 0 AND 99 GROUP BY ALL"),
        "q5_whole_payloads": _sql(CANDLES + LEVELS + WHOLE, "SELECT * FROM whole"),
        "r1_mixture_ladders": _sql(LABELS + MIXTURE, "SELECT asset, current_time_ms, " + ", ".join(f"round(max(x) FILTER (WHERE i = {i + 1}), 6) AS q{i}" for i in (0, 1, 24, 49, 50, 98, 99)) + ", round(avg(abs(x - m)), 6) AS width FROM mixed JOIN middle USING (asset, current_time_ms) GROUP BY ALL"),
        "r9_still_mixtures": _sql(LABELS + STILL, "SELECT asset, current_time_ms, model, (count(*) FILTER (WHERE v = px))::INT AS n_atom, " + ", ".join(f"round(max(v) FILTER (WHERE i = {i + 1}), 6) AS q{i}" for i in (0, 30, 60, 99)) + ", round(sum(v), 4) AS total FROM still GROUP BY ALL"),
        "r15_empirical_ladders": _sql(LABELS + PAIRS, "SELECT asset, current_time_ms, round(min(x), 9) AS low, round(max(x), 9) AS high, round(sum(x), 4) AS total FROM (SELECT asset, current_time_ms, price + unnest(list_aggregate(moves, 'quantile_cont', list_transform(range(1, 101), lambda v: (2 * v - 1) / 200.0::DOUBLE))) - list_aggregate(moves, 'quantile_cont', 0.5) AS x FROM kept JOIN priced USING (asset, current_time_ms)) GROUP BY ALL"),
        "a24_hour_autocorrelation": _sql(CANDLES + ", l AS (SELECT *, lag(d_ten) OVER (PARTITION BY asset, venue ORDER BY open_time_ms) AS x FROM moved)", f"SELECT (open_time_ms // {H} % 24)::INT AS hour, count(*) AS n, round(corr(d_ten, x), 6) AS lag1 FROM l WHERE d_ten IS NOT NULL AND x IS NOT NULL GROUP BY ALL"),
        "a25_trigger_rates": _sql(ALL_PROMPTS, f"SELECT asset, kind, count(*) AS n, round(count(*) / any_value(total), 6) AS share, round(count(*) / any_value(hours), 6) AS an_hour FROM built JOIN (SELECT asset, count(*) AS total, (max(current_time_ms) - min(current_time_ms)) / {H}.0::DOUBLE AS hours FROM built GROUP BY asset) s USING (asset) GROUP BY asset, kind"),
        "a15_prompt_hours": _sql(CANDLES + HOURS, "SELECT asset, t AS current_time_ms, n AS n_closes, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("mad", "ewma", "rv", "rng", "p90", "activity")) + ", round(jump_ratio, 6) AS jump_ratio, " + ", ".join(f"round(bin{i}, 9) AS bin{i}" for i in (0, 10, 25, 40, 49)) + " FROM agg LEFT JOIN (SELECT asset, t, " + ", ".join(f"max(mean) FILTER (WHERE k = {i}) AS bin{i}" for i in (0, 10, 25, 40, 49)) + " FROM rising GROUP BY ALL) USING (asset, t)"),
        "s18_pruned_captures": _sql(SAVED, f"SELECT asset, folder_ms FROM saved WHERE folder_ms >= 1706054400000 - 240 * {H}"),
        "x9_once": _sql("", "SELECT DISTINCT asset, venue, seq FROM ticks"),
        "x7_sliding_flow": _sql("", f"SELECT asset, venue, f AS from_ms, f + 6 * {H} AS to_ms, sum(CASE WHEN buyer_is_maker THEN -qty ELSE qty END) AS flow, sum(qty) AS volume, count(*) AS n FROM (SELECT *, unnest(range((recv_ts_ms // (2 * {H}) - 2) * 2 * {H}, recv_ts_ms // (2 * {H}) * 2 * {H} + 1, 2 * {H})) AS f FROM ticks) GROUP BY asset, venue, f"),
        "x8_activity_sessions": _sql(", g AS (SELECT *, (recv_ts_ms - lag(recv_ts_ms) OVER w > 1800000)::INT AS new FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY recv_ts_ms)), s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY asset ORDER BY recv_ts_ms) AS k FROM g)", "SELECT asset, min(recv_ts_ms) AS from_ms, max(recv_ts_ms) + 1800000 AS to_ms, count(*) AS n, sum(qty) AS qty FROM s GROUP BY asset, k"),
        "x10_trailing_window": _sql("", f"SELECT asset, venue, seq, count(*) OVER w AS n, round(sum(qty) OVER w, 6) AS trailing FROM ticks WINDOW w AS (PARTITION BY asset, venue ORDER BY recv_ts_ms RANGE BETWEEN {6 * H - 1} PRECEDING AND CURRENT ROW)"),
        "q2_all_features": _sql(FEATURES + CANDLES + ALL_FEATURES, "SELECT asset, current_time_ms, stale_ms, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in (*FEATURE_NAMES, *MORE_NAMES)) + " FROM whole"),
        "w4_recent_ofi": _sql(OFI, "SELECT asset, current_time_ms, venue, n, n_recent, round(CASE WHEN n >= 5 AND n_recent >= 2 AND gross > 0 THEN net / gross ELSE 0 END, 6) + 0.0::DOUBLE AS value FROM os"),
        "a19_run_report": _sql(SCORES + RUNS, "SELECT asset, model, n, n_scored, n_unreadable, round(crps_mean, 6) AS crps_mean, median_ms, round(CASE WHEN n < 20 THEN max_ms ELSE all_ms[floor(0.95::DOUBLE * (n + 1))::INT] + (0.95::DOUBLE * (n + 1) - floor(0.95::DOUBLE * (n + 1))) * (all_ms[floor(0.95::DOUBLE * (n + 1))::INT + 1] - all_ms[floor(0.95::DOUBLE * (n + 1))::INT]) END, 6) AS p95_ms, max_ms, median_ms <= 5 AS within_budget FROM rs"),
        "p6_payload_rules": _sql(
            ", f AS (SELECT asset, recv_ts_ms AS current_time_ms, seq % 16 AS fault FROM ticks)",
            "SELECT asset, current_time_ms, concat_ws(',', CASE WHEN fault <= 4 THEN what END, CASE WHEN asset NOT IN ('click', 'error', 'purchase') THEN 'asset' END, CASE WHEN fault > 4 AND (asset IN ('click', 'error', 'purchase') OR fault NOT IN (5, 12)) THEN what END) AS codes FROM f LEFT JOIN (VALUES "
            + ", ".join(f"({n}, '{code}')" for n, code in FAULTS.items()) + ") w(fault, what) USING (fault)",
        ),
    }
