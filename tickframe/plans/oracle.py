"""The demo queries as plain SQL over the source tables: range joins and window functions, no slots."""

from __future__ import annotations

from tickframe import market
from tickframe.config import DEMO, Config

A, B = market.VENUE_A, market.VENUE_B
KEY = "g.exchange, g.symbol"
Z = ("taker_imbalance", "ofi", "return_value", "oi_change", "premium", "funding_rate", "activity")


def late(name: str, source: str, keys: str = "exchange, symbol") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (h) FROM (SELECT *, max(us) OVER (PARTITION BY {keys} ORDER BY recv_us, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {source}) WHERE h IS NULL OR us >= h)"""


def ctes(c: Config = DEMO) -> dict[str, str]:
    """Common table expressions by name, each with what it needs before it (in this order)."""
    t, w = c.tick, [c.ticks(x) for x in c.windows]
    seen = f"e.us <= g.tick_no * {t} AND e.recv_us <= g.tick_no * {t}"
    same = "e.exchange = g.exchange AND e.symbol = g.symbol"
    inside = f"e.us > (g.tick_no - g.window_ticks) * {t}"
    cell = "g.exchange, g.symbol, g.window_ticks, g.tick_no"
    rng = c.ticks(c.lookback)
    zs = {}
    for m in Z:
        zs[f"z_{m}"] = f"""z_{m} AS (
  WITH v AS (SELECT exchange, symbol, window_ticks, tick_no, {m} AS x, lag(tick_no) OVER (PARTITION BY exchange, symbol, window_ticks ORDER BY tick_no) AS tp FROM metrics WHERE {m} IS NOT NULL)
  SELECT v.exchange, v.symbol, v.window_ticks, v.tick_no, CASE WHEN count(h.x) >= 2 AND max(h.x) > min(h.x) THEN (any_value(v.x) - avg(h.x)) / stddev_pop(h.x) END AS z,
    coalesce(count(h.x) >= 2 AND max(h.x) > min(h.x) AND min(h.tick_no) <= v.tick_no - {rng}, false) AS warm
  FROM v LEFT JOIN v h ON h.exchange = v.exchange AND h.symbol = v.symbol AND h.window_ticks = v.window_ticks AND h.tick_no <= v.tp AND h.tick_no > v.tp - {rng}
  GROUP BY v.exchange, v.symbol, v.window_ticks, v.tick_no)"""
    weights = ", ".join(f"{x}::DOUBLE" for x in c.depth_weights)

    def walk(side: str, sell: bool) -> str:
        sign = "-" if sell else ""
        return f"CASE WHEN max({side}_run) >= {c.walk_notional} - 1e-9 THEN {sign}({c.walk_notional} / sum({side}_take) / any_value(mid) - 1) * 10000 END"

    levels = "".join(
        f"""l_{s} AS (SELECT exchange, symbol, tick_no, price, qty, row_number() OVER (PARTITION BY exchange, symbol, tick_no ORDER BY price {d}) AS i FROM standing WHERE side = '{S}'),
"""
        for s, S, d in (("bid", "BID", "DESC"), ("ask", "ASK", "ASC"))
    )
    sides = "".join(
        f"""s_{s} AS (SELECT exchange, symbol, tick_no, sum(qty * ([{weights}])[i]) AS depth, max(price) FILTER (WHERE i = 1) AS best, max(qty) FILTER (WHERE i = 1) AS top FROM l_{s} WHERE i <= {c.depth} GROUP BY ALL),
r_{s} AS (SELECT exchange, symbol, tick_no, price, least(price * qty, greatest(0, {c.walk_notional} - coalesce(sum(price * qty) OVER (PARTITION BY exchange, symbol, tick_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS cash, sum(price * qty) OVER (PARTITION BY exchange, symbol, tick_no) AS held FROM l_{s} WHERE i <= {c.depth}),
k_{s} AS (SELECT exchange, symbol, tick_no, CASE WHEN max(held) >= {c.walk_notional} - 1e-9 THEN {c.walk_notional} / sum(cash / price) END AS vwap FROM r_{s} GROUP BY ALL),
"""
        for s in ("bid", "ask")
    )
    return {
        "market": market.ORACLE.strip(),
        "trades": late("trades", "trades0"),
        "quotes": late("quotes", "quotes0"),
        "liquidations": late("liquidations", "liquidations0"),
        "levels": late("levels", "levels0"),
        "prices": late("prices", "(SELECT exchange, symbol, us, recv_us, ord, price FROM trades UNION ALL SELECT exchange, symbol, us, recv_us, ord, mark FROM quotes)"),
        "ticks": f"ticks AS (SELECT unnest(range(min(recv_us) // {t} + 1, greatest(min(recv_us) // {t} + 1, (max(recv_us) + {t - 1}) // {t}) + 1)) AS tick_no FROM base)",
        "keys": f"keys AS (SELECT * FROM (VALUES ('{A}'), ('{B}')) a(exchange), (VALUES ('{market.SYMBOLS[0]}'), ('{market.SYMBOLS[1]}')) b(symbol))",
        "ktick": "ktick AS (SELECT * FROM ticks, keys)",
        "grid": f"grid AS (SELECT * FROM ktick, (VALUES {', '.join(f'({x})' for x in w)}) w(window_ticks))",
        "trade_flow": f"""trade_flow AS (
  WITH s AS (SELECT {cell}, coalesce(sum(e.notional) FILTER (WHERE {inside} AND side = 'BUY'), 0) AS buy, coalesce(sum(e.notional) FILTER (WHERE {inside} AND side = 'SELL'), 0) AS sell,
      coalesce(sum(e.notional) FILTER (WHERE {inside} AND e.notional >= {c.large_trade}), 0) AS large, count(e.us) FILTER (WHERE {inside}) AS n,
      coalesce(sum(e.notional) FILTER (WHERE NOT ({inside})), 0) AS prev, count(e.us) FILTER (WHERE NOT ({inside})) AS pn
    FROM grid g LEFT JOIN trades e ON {same} AND {seen} AND e.us > (g.tick_no - 2 * g.window_ticks) * {t} GROUP BY {cell})
  SELECT exchange, symbol, window_ticks, tick_no, buy AS aggressive_buy_notional, sell AS aggressive_sell_notional, (buy - sell) / nullif(buy + sell, 0) AS taker_imbalance,
    (buy + sell) / nullif(prev, 0) - 1 AS trade_notional_impulse, n::DOUBLE / nullif(pn, 0) - 1 AS trade_count_impulse, (buy + sell) / nullif(n, 0) AS average_trade_notional, large / nullif(buy + sell, 0) AS large_trade_share, n AS trades FROM s)""",
        "pairs": "pairs AS (SELECT *, lag(us) OVER o AS prev_us, pow(ln(price / lag(price) OVER o), 2) AS r2 FROM prices WINDOW o AS (PARTITION BY exchange, symbol ORDER BY recv_us, ord))",
        "price": f"""price AS (
  SELECT {cell}, last(e.price ORDER BY e.us, e.recv_us, e.ord) / first(e.price ORDER BY e.us, e.recv_us, e.ord) - 1 AS return_value,
    CASE WHEN count(r2) FILTER (WHERE prev_us > (g.tick_no - g.window_ticks) * {t}) >= 2 THEN sqrt(sum(r2) FILTER (WHERE prev_us > (g.tick_no - g.window_ticks) * {t})) END AS realized_volatility, count(e.us) AS prices,
    last(e.price ORDER BY e.us, e.recv_us, e.ord) - first(e.price ORDER BY e.us, e.recv_us, e.ord) AS move
  FROM grid g LEFT JOIN pairs e ON {same} AND {seen} AND {inside} GROUP BY {cell})""",
        "price_range": f"price_range AS (SELECT {KEY}, g.tick_no, max(e.price) AS trailing_high, min(e.price) AS trailing_low FROM ktick g LEFT JOIN prices e ON {same} AND {seen} AND e.us > (g.tick_no - {c.ticks(c.breakout)}) * {t} GROUP BY {KEY}, g.tick_no)",
        "atr": f"""atr AS (
  WITH bars AS (SELECT {KEY}, g.tick_no, e.us // {c.atr_bar} AS bar, max(e.price) AS hi, min(e.price) AS lo, last(e.price ORDER BY e.us, e.recv_us, e.ord) AS cl, count(*) AS n
      FROM ktick g JOIN prices e ON {same} AND {seen} AND e.us > (g.tick_no - {c.ticks(c.atr_period)}) * {t} GROUP BY {KEY}, g.tick_no, e.us // {c.atr_bar}),
    tr AS (SELECT *, lag(cl) OVER (PARTITION BY exchange, symbol, tick_no ORDER BY bar) AS pc FROM bars),
    m AS (SELECT exchange, symbol, tick_no, CASE WHEN sum(n) >= 2 THEN avg(greatest(hi - lo, coalesce(abs(hi - pc), 0), coalesce(abs(lo - pc), 0))) END AS atr FROM tr GROUP BY ALL)
  SELECT {KEY}, g.tick_no, atr FROM ktick g LEFT JOIN m USING (exchange, symbol, tick_no))""",
        "oi_now": f"oi_now AS (SELECT {KEY}, g.tick_no, last(e.oi ORDER BY e.us, e.ord) AS oi, last(e.us ORDER BY e.us, e.ord) AS oi_us, last(e.funding ORDER BY e.us, e.ord) AS funding_rate, last(e.mark ORDER BY e.us, e.ord) / last(e.index ORDER BY e.us, e.ord) - 1 AS premium FROM ktick g LEFT JOIN quotes e ON {same} AND {seen} GROUP BY {KEY}, g.tick_no)",
        "oi_then": f"oi_then AS (SELECT {cell}, last(e.oi ORDER BY e.us, e.ord) AS anchor FROM grid g LEFT JOIN quotes e ON {same} AND {seen} AND e.us <= (g.tick_no - g.window_ticks) * {t} GROUP BY {cell})",
        "open_interest": f"open_interest AS (SELECT exchange, symbol, window_ticks, tick_no, oi, oi_us, oi - anchor AS oi_change, oi / nullif(anchor, 0) - 1 AS oi_pct_change, greatest(0, tick_no * {t} - oi_us) / 1000.0::DOUBLE AS oi_age_ms FROM oi_then JOIN oi_now USING (exchange, symbol, tick_no))",
        "liquidation": f"""liquidation AS (SELECT {cell}, coalesce(sum(e.notional) FILTER (WHERE position = 'LONG'), 0) AS long_notional, coalesce(sum(e.notional) FILTER (WHERE position = 'SHORT'), 0) AS short_notional, coalesce(sum(e.notional), 0) AS activity, count(e.us) AS liquidations
  FROM grid g LEFT JOIN liquidations e ON {same} AND {seen} AND {inside} GROUP BY {cell})""",
        "changes": "changes AS (SELECT *, qty - coalesce(lag(qty) OVER (PARTITION BY exchange, symbol, side, price ORDER BY recv_us, ord), 0) AS d FROM levels)",
        "book_flow": f"""book_flow AS (
  WITH j AS (SELECT {cell}, e.* EXCLUDE (exchange, symbol) FROM grid g LEFT JOIN changes e ON {same} AND {seen} AND {inside}),
    f AS (SELECT *, min(us) FILTER (WHERE d < 0) OVER (PARTITION BY exchange, symbol, window_ticks, tick_no) AS t0 FROM j)
  SELECT exchange, symbol, window_ticks, tick_no, coalesce(sum(CASE WHEN side = 'BID' THEN d ELSE -d END), 0) AS ofi, coalesce(sum(d) FILTER (WHERE side = 'BID'), 0) AS bid_liquidity_change, coalesce(sum(d) FILTER (WHERE side = 'ASK'), 0) AS ask_liquidity_change,
    coalesce(sum(d) FILTER (WHERE d > 0), 0) AS liquidity_added, coalesce(-sum(d) FILTER (WHERE d < 0), 0) AS liquidity_removed,
    CASE WHEN any_value(t0) IS NOT NULL THEN coalesce(sum(d) FILTER (WHERE d > 0 AND us > t0), 0) / nullif((tick_no * {t} - any_value(t0)) / 1e6::DOUBLE, 0) END AS recovery_per_second FROM f GROUP BY exchange, symbol, window_ticks, tick_no)""",
        "book": f"""standing AS (SELECT * FROM (SELECT {KEY}, g.tick_no, e.side, e.price, last(e.qty ORDER BY e.us, e.ord) AS qty, max(e.us) AS us FROM ktick g JOIN levels e ON {same} AND {seen} GROUP BY {KEY}, g.tick_no, e.side, e.price) WHERE qty > 0),
{levels}{sides}b_us AS (SELECT exchange, symbol, tick_no, max(us) AS book_us FROM standing GROUP BY ALL),
book AS (SELECT {KEY}, g.tick_no, b.depth AS weighted_bid_depth, a.depth AS weighted_ask_depth, a.best - b.best AS spread, (a.best + b.best) / 2 AS mid_price, (a.best - b.best) / ((a.best + b.best) / 2) AS relative_spread,
    (a.best * b.top + b.best * a.top) / nullif(a.top + b.top, 0) AS microprice, (b.depth - a.depth) / nullif(a.depth + b.depth, 0) AS depth_imbalance,
    (ka.vwap / ((a.best + b.best) / 2) - 1) * 10000 AS buy_slippage_bps, -(kb.vwap / ((a.best + b.best) / 2) - 1) * 10000 AS sell_slippage_bps, CASE WHEN a.best IS NOT NULL AND b.best IS NOT NULL THEN book_us END AS book_us
  FROM ktick g LEFT JOIN (s_bid b JOIN s_ask a USING (exchange, symbol, tick_no) JOIN k_ask ka USING (exchange, symbol, tick_no) JOIN k_bid kb USING (exchange, symbol, tick_no) JOIN b_us USING (exchange, symbol, tick_no)) USING (exchange, symbol, tick_no))""",
        "metrics": """metrics AS (SELECT * FROM trade_flow JOIN price USING (exchange, symbol, window_ticks, tick_no) JOIN book_flow USING (exchange, symbol, window_ticks, tick_no) JOIN open_interest USING (exchange, symbol, window_ticks, tick_no)
  JOIN liquidation USING (exchange, symbol, window_ticks, tick_no) JOIN (SELECT exchange, symbol, tick_no, funding_rate, premium FROM oi_now) USING (exchange, symbol, tick_no) LEFT JOIN book USING (exchange, symbol, tick_no))""",
        **zs,
        "single": f"""single AS (
  WITH lt AS (SELECT {KEY}, g.tick_no, max(e.us) AS trade_us FROM ktick g LEFT JOIN trades e ON {same} AND {seen} GROUP BY {KEY}, g.tick_no),
    fb AS (SELECT exchange, symbol, min((greatest(us, recv_us) + {t - 1}) // {t}) AS book_tick FROM levels GROUP BY ALL),
    zz AS (SELECT m.*, trade_us, book_tick, {', '.join(f'z_{m}.z AS {m}_z, coalesce(z_{m}.warm, false) AS {m}_warm' for m in Z)}
      FROM metrics m JOIN lt USING (exchange, symbol, tick_no) LEFT JOIN fb USING (exchange, symbol) {' '.join(f'LEFT JOIN z_{m} USING (exchange, symbol, window_ticks, tick_no)' for m in Z)}),
    q AS (SELECT *, coalesce(book_tick > tick_no - {max(w)}, true) AS warmup, tick_no * {t} - oi_us > {c.oi_stale_after} AS stale, NOT (taker_imbalance_warm AND ofi_warm AND return_value_warm AND oi_change_warm AND premium_warm AND activity_warm) AS cold,
      greatest(trade_us, oi_us, book_us) AS newest_us FROM zz)
  SELECT *, CASE WHEN return_value IS NULL OR oi_change IS NULL THEN NULL WHEN return_value = 0 OR oi_change = 0 THEN 'FLAT' ELSE (CASE WHEN return_value > 0 THEN 'PRICE_UP' ELSE 'PRICE_DOWN' END) || (CASE WHEN oi_change > 0 THEN '_OI_UP' ELSE '_OI_DOWN' END) END AS price_oi_state,
    CASE WHEN taker_imbalance IS NULL OR return_value IS NULL OR oi_change IS NULL OR funding_rate IS NULL THEN NULL WHEN least(taker_imbalance, return_value, oi_change, funding_rate) > 0 THEN 'CROWDED_LONG' WHEN greatest(taker_imbalance, return_value, oi_change, funding_rate) < 0 THEN 'CROWDED_SHORT' ELSE 'MIXED' END AS crowding_state,
    abs(return_value_z) >= {c.jump_z} AS abnormal_jump, CASE WHEN liquidations > 0 THEN oi_change < 0 END AS activity_with_oi_decline, greatest(0, tick_no * {t} - newest_us) / 1000.0::DOUBLE AS data_age_ms,
    coalesce(trade_us IS NOT NULL AND NOT warmup AND oi IS NOT NULL AND NOT cold AND trades > 0, false) AS is_warm, mid_price IS NOT NULL AND coalesce(NOT stale, true) AS is_healthy,
    concat_ws(',', CASE WHEN trade_us IS NULL THEN 'NO_TRADES' END, CASE WHEN mid_price IS NULL THEN 'BOOK_UNSYNCHRONIZED' END, CASE WHEN warmup THEN 'BOOK_GENERATION_WARMUP' END, CASE WHEN oi IS NULL THEN 'OPEN_INTEREST_MISSING' END, CASE WHEN stale THEN 'OPEN_INTEREST_STALE' END, CASE WHEN trades = 0 AND trade_us IS NOT NULL THEN 'NO_TRADES' END, CASE WHEN cold THEN 'NOT_WARM' END) AS reasons
  FROM q)""",
        "pair": f"""pair AS (SELECT a.symbol, a.window_ticks, a.tick_no, COLUMNS(a.* EXCLUDE (exchange, symbol, window_ticks, tick_no)) AS 'a_\\0', COLUMNS(b.* EXCLUDE (exchange, symbol, window_ticks, tick_no)) AS 'b_\\0'
  FROM (SELECT * FROM single WHERE exchange = '{A}') a JOIN (SELECT * FROM single WHERE exchange = '{B}') b ON a.symbol = b.symbol AND a.window_ticks = b.window_ticks AND a.tick_no = b.tick_no)""",
    }


#: What each expression needs (directly); order is that of ``ctes``.
NEEDS = {
    "trades": ("market",), "quotes": ("market",), "liquidations": ("market",), "levels": ("market",), "prices": ("trades", "quotes"), "ticks": ("market",), "keys": (), "ktick": ("ticks", "keys"), "grid": ("ktick",),
    "trade_flow": ("grid", "trades"), "pairs": ("prices",), "price": ("grid", "pairs"), "price_range": ("ktick", "prices"), "atr": ("ktick", "prices"), "oi_now": ("ktick", "quotes"), "oi_then": ("grid", "quotes"), "open_interest": ("oi_now", "oi_then"),
    "liquidation": ("grid", "liquidations"), "changes": ("levels",), "book_flow": ("grid", "changes"), "book": ("ktick", "levels"), "metrics": ("trade_flow", "price", "book_flow", "open_interest", "liquidation", "book"),
    **{f"z_{m}": ("metrics",) for m in Z}, "single": tuple(f"z_{m}" for m in Z), "pair": ("single",),
}


def sql(select: str, *needs: str, cfg: Config = DEMO) -> str:
    todo, have = list(needs), set()
    while todo:
        n = todo.pop()
        if n not in have:
            have.add(n)
            todo += NEEDS.get(n, ())
    # metrics stand once: they are scanned by every z-score
    text = [("metrics AS MATERIALIZED" + s.removeprefix("metrics AS")) if n == "metrics" else s for n, s in ctes(cfg).items() if n in have]
    return ("WITH " + ",\n".join(text) + "\n" if text else "") + select
