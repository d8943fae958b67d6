"""DuckDB SQL of the queries, written on its own and not from the frames' plans."""

from __future__ import annotations

AS_OF, CUT_FROM = "2001-10-17 12:00:00", "2001-10-03"

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (sql, needs)


def r(expr: str, name: str | None = None) -> str:
    """Six decimals; adding zero turns a negative zero into zero."""
    return f"round({expr}, 6) + 0.0 as {name or expr}"


def sql(body: str, *needs: str) -> str:
    """``body`` with the tables it needs as common table expressions, each after its own needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][1]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} as ({CTE[n][0]})" for n in order)
    return f"with recursive {head}\n{body}" if order else body


KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
W = "(partition by ticker order by trade_date)"
cte(
    "bars",
    f"""select l_returnflag as ticker, cast(l_shipdate as date) as trade_date, min_by(l_extendedprice, {KEY}) as open, max(l_extendedprice) as high, min(l_extendedprice) as low,
    max_by(l_extendedprice, {KEY}) as close, max_by(l_extendedprice, {KEY}) as adj_close, cast(sum(l_quantity) as bigint) as volume from lineitem group by 1, 2""",
)
cte("cal", "select cast(d as date) as session_date, cast(d as timestamp) + interval 21 hour as close_utc from generate_series(timestamp '1995-01-01', timestamp '2002-12-31', interval 1 day) t(d) where dayofweek(d) between 1 and 5")
cte("cut", f"select max(session_date) as cutoff from cal where close_utc <= timestamp '{AS_OF}' and session_date >= date '{CUT_FROM}'", "cal")
cte("clean", f"select bars.*, ln(adj_close) - ln(lag(adj_close) over {W}) as log_return from bars where trade_date in (select session_date from cal, cut where session_date <= cutoff)", "bars", "cal", "cut")
cte(
    "basic",
    "select *, log_return * log_return as r2, ln(high / low) ** 2 / (4 * ln(2.0::double)) as park_var, 0.5::double * ln(high / low) ** 2 - (2 * ln(2.0::double) - 1) * ln(close / open) ** 2 as gk_var from clean",
    "clean",
)
_full = lambda c, n: f"case when count({c}) over (partition by ticker order by trade_date rows {n - 1} preceding) = {n} then avg({c}) over (partition by ticker order by trade_date rows {n - 1} preceding) end"
cte(
    "feat",
    "select ticker, trade_date, log_return, "
    + ", ".join(f"lag(log_return, {k}) over {W} as ret_lag_{k}" for k in range(1, 6))
    + ", r2, park_var, gk_var, "
    + ", ".join(f"sqrt(252 * {_full('r2', n)}) as rvol_{n}" for n in (5, 21, 63))
    + f", {_full('gk_var', 5)} as har_rv_w, {_full('gk_var', 22)} as har_rv_m, lead(gk_var, 1) over {W} as target_gk_var_next from basic",
    "basic",
)
cte("ret", f"select ticker, trade_date, log_return, log_return * log_return as r2, row_number() over {W} - 1 as t, count(*) over (partition by ticker) as n from clean where log_return is not null", "clean")
cte("seed", "select ticker, avg(r2) as s from ret where t < 252 group by ticker", "ret")
cte(
    "ewma",
    """select ret.ticker, t, n, trade_date, s as v, r2 from ret join seed using (ticker) where t = 0
    union all select ret.ticker, ret.t, ret.n, ret.trade_date, 0.94::double * ewma.v + (1 - 0.94::double) * ewma.r2, ret.r2 from ewma join ret on ret.ticker = ewma.ticker and ret.t = ewma.t + 1""",
    "ret",
    "seed",
)
cte(
    "har_rows",
    f"""select ticker, trade_date, row_number() over {W} - 1 as t, count(*) over (partition by ticker) as n, date_trunc('month', trade_date) as month, target_gk_var_next as target,
    case when gk_var is not null then ln(greatest(gk_var, 1e-12::double)) end as x1, case when har_rv_w is not null then ln(greatest(har_rv_w, 1e-12::double)) end as x2, case when har_rv_m is not null then ln(greatest(har_rv_m, 1e-12::double)) end as x3 from feat""",
    "feat",
)
cte("har_train", "select ticker, t, x1, x2, x3, ln(target) as y from har_rows where x1 is not null and x2 is not null and x3 is not null and target > 0", "har_rows")
cte("har_first", "select ticker, month, min(t) as t0 from har_rows where t >= 756 and n > 756 group by 1, 2", "har_rows")
cte(
    "har_moments",
    """select f.ticker, f.month, f.t0, count(*) as n_train, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my, covar_pop(x1, x1) as a11, covar_pop(x1, x2) as a12, covar_pop(x1, x3) as a13,
    covar_pop(x2, x2) as a22, covar_pop(x2, x3) as a23, covar_pop(x3, x3) as a33, covar_pop(x1, y) as g1, covar_pop(x2, y) as g2, covar_pop(x3, y) as g3, var_pop(y) as gy
    from har_first f join har_train h on h.ticker = f.ticker and h.t <= f.t0 - 2 group by 1, 2, 3""",
    "har_first",
    "har_train",
)
cte(
    "har_det",
    """select *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) as d,
    g1 * (a22 * a33 - a23 * a23) - a12 * (g2 * a33 - a23 * g3) + a13 * (g2 * a23 - a22 * g3) as d1,
    a11 * (g2 * a33 - a23 * g3) - g1 * (a12 * a33 - a23 * a13) + a13 * (a12 * g3 - g2 * a13) as d2,
    a11 * (a22 * g3 - g2 * a23) - a12 * (a12 * g3 - g2 * a13) + g1 * (a12 * a23 - a22 * a13) as d3 from har_moments""",
    "har_moments",
)
cte(
    "har_coef",
    """select ticker, month, t0, n_train, my - (d1 * m1 + d2 * m2 + d3 * m3) / d as b0, d1 / d as b1, d2 / d as b2, d3 / d as b3, greatest(gy - (d1 * g1 + d2 * g2 + d3 * g3) / d, 0.0::double) as s2 from har_det where d != 0""",
    "har_det",
)
cte(
    "har",
    """select c.ticker, h.trade_date, exp(b0 + b1 * p.x1 + b2 * p.x2 + b3 * p.x3 + 0.5::double * s2) as raw
    from har_rows h join har_coef c on c.ticker = h.ticker and c.month = h.month join har_rows p on p.ticker = h.ticker and p.t = h.t - 1 where h.t >= 756""",
    "har_rows",
    "har_coef",
)
cte("har_newest", "select ticker, max(month) as month from har_coef group by 1", "har_coef")
cte(
    "har_last",
    """select h.ticker, h.trade_date as last_date, exp(b0 + b1 * x1 + b2 * x2 + b3 * x3 + 0.5::double * s2) as raw from har_rows h join har_newest using (ticker) join har_coef c on c.ticker = h.ticker and c.month = har_newest.month where h.t = h.n - 1""",
    "har_rows",
    "har_coef",
    "har_newest",
)
cte("ewma_last", "select ticker, trade_date as last_date, 0.94::double * v + (1 - 0.94::double) * r2 as var_forecast from ewma where t = n - 1 and n > 756", "ewma")
cte("settled", "select ticker, trade_date, 'ewma_094' as model, v as var_forecast, false as is_live from ewma where t >= 756 union all select ticker, trade_date, 'har_rv', greatest(raw, 1e-8::double), false from har", "ewma", "har")
cte("after", "select ticker, (select min(session_date) from cal where session_date > m and session_date <= m + 14) as trade_date from (select ticker, max(trade_date) as m from clean group by 1)", "clean", "cal")
cte(
    "live",
    "select ticker, trade_date, 'ewma_094' as model, var_forecast, true as is_live from ewma_last join after using (ticker) union all select ticker, trade_date, 'har_rv', greatest(raw, 1e-8::double), true from har_last join after using (ticker)",
    "ewma_last",
    "har_last",
    "after",
)
cte("fore", "select * from settled union all select * from live", "settled", "live")
cte("abl_all", "select f.*, gk_var from settled f join feat using (ticker, trade_date) where gk_var > 0", "settled", "feat")
cte("abl_days", "select ticker, trade_date from abl_all group by 1, 2 having count(distinct model) = 2", "abl_all")
cte(
    "abl",
    """select ticker, model, count(*) as n_obs, avg(gk_var / var_forecast - ln(gk_var / var_forecast) - 1) as qlike, sqrt(avg((100 * sqrt(252 * gk_var) - 100 * sqrt(252 * var_forecast)) ** 2)) as rmse_ann_vol_pct,
    min(trade_date) as eval_start, max(trade_date) as eval_end from abl_all join abl_days using (ticker, trade_date) group by 1, 2""",
    "abl_all",
    "abl_days",
)
cte("abl_avg", "select ticker, model, qlike, rmse_ann_vol_pct from abl union all select 'AVERAGE', model, avg(qlike), avg(rmse_ann_vol_pct) from abl group by model", "abl")
cte("levels", "select * from (values (95, 1.6448536269514722::double), (99, 2.3263478740408408::double)) z(level, z)")
cte("common0", "select f.ticker, f.trade_date, model, var_forecast, log_return from settled f join ret using (ticker, trade_date)", "settled", "ret")
cte("common", "select * from common0 where (ticker, trade_date) in (select (ticker, trade_date) from common0 group by ticker, trade_date having count(distinct model) = 2)", "common0")


def cover(source: str) -> str:
    p, x, n = "(1 - level / 100.0::double)", "x::double", "n::double"
    term = lambda c, s: f"case when {c} > 0 then {c} * ln({s}) else 0.0 end"
    null = f"{term(f'({n} - {x})', f'1 - {p}')} + {term(x, p)}"
    other = f"{term(f'({n} - {x})', f'1 - {x} / {n}')} + {term(x, f'{x} / {n}')}"
    return f"""select ticker, model, level, n as n_obs, {p} * n as expected_breaches, x as observed_breaches, {x} / {n} as breach_rate, greatest(-2 * (({null}) - ({other})), 0.0::double) as kupiec_lr, eval_start, eval_end
    from (select ticker, model, level, count(*) as n, count(*) filter (where log_return < -z * sqrt(var_forecast)) as x, min(trade_date) as eval_start, max(trade_date) as eval_end from {source}, levels group by 1, 2, 3)"""


cte("cov", cover("common"), "common", "levels")
cte(
    "factors",
    """select m.ticker, m.month, m.first_date, avg(r2) / avg(gk_var) as factor from (select ticker, date_trunc('month', trade_date) as month, min(trade_date) as first_date from common group by 1, 2) m
    join feat on feat.ticker = m.ticker and feat.trade_date < m.first_date and r2 is not null and gk_var > 0 group by 1, 2, 3""",
    "common",
    "feat",
)
cte("cal_rows", "select c.ticker, c.trade_date, model || '_cal' as model, var_forecast * factor as var_forecast, log_return from common c join factors f on f.ticker = c.ticker and f.month = date_trunc('month', c.trade_date) where model = 'har_rv'", "common", "factors")
cte("cov_cal0", cover("cal_rows"), "cal_rows", "levels")
cte("cov_cal", "select * from cov union all select * from cov_cal0 where coalesce((select avg(breach_rate) >= 0.06 from cov where level = 95 and model = 'har_rv'), false)", "cov", "cov_cal0")
cte("daily", "select f.ticker, f.trade_date, model, level, log_return, z * sqrt(var_forecast) as var_threshold, log_return < -z * sqrt(var_forecast) as breach from fore f join ret using (ticker, trade_date), levels", "fore", "ret", "levels")
cte("versus", "select f.ticker, f.trade_date, model, var_forecast, gk_var as realized_gk_var, 100 * sqrt(252 * var_forecast) as f_vol, 100 * sqrt(252 * gk_var) as r_vol from fore f join feat using (ticker, trade_date) where gk_var > 0", "fore", "feat")
cte("newest", "select ticker, model, arg_max(row(trade_date, var_forecast, is_live), trade_date) as x from fore group by 1, 2", "fore")
cte("vix", "select cast(o_orderdate as date) as trade_date, avg(o_totalprice) as vix_close from orders group by 1")
cte("moves", f"select *, abs(ln(close) - ln(lag(close) over {W})) as raw_move, abs(ln(adj_close) - ln(lag(adj_close) over {W})) as adj_move from bars", "bars")

BAR = "ticker, trade_date, round(open, 6) + 0.0 as open, round(high, 6) + 0.0 as high, round(low, 6) + 0.0 as low, round(close, 6) + 0.0 as close, round(adj_close, 6) + 0.0 as adj_close, volume"
FEATURES = ["log_return", *[f"ret_lag_{k}" for k in range(1, 6)], "r2", "park_var", "gk_var", "rvol_5", "rvol_21", "rvol_63", "har_rv_w", "har_rv_m", "target_gk_var_next"]
FAULTS = {
    **{f"{c}_null": f"{c} is null" for c in ("ticker", "trade_date", "open", "high", "low", "close", "adj_close")},
    **{f"{c}_not_positive": f"{c} <= 0" for c in ("open", "high", "low", "close", "adj_close")},
    "volume_negative": "volume < 0",
    "high_below_low": "high < low",
    "open_outside_range": "open < low or open > high",
    "close_outside_range": "close < low or close > high",
    "duplicate_key": "copies > 1",
}
COVER = f"ticker, model, level, n_obs, {r('expected_breaches')}, observed_breaches, {r('breach_rate')}, {r('kupiec_lr')}, eval_start, eval_end, kupiec_lr > 3.841458820694124 as kupiec_reject"
GARCH_STEP = "(400.0::double + 0.08::double * eps * eps + 0.85::double * v)"

ORACLES: dict[str, str] = {
    "bars_from_trades": sql(f"select {BAR} from bars", "bars"),
    "validation_violations": sql(
        'select * from (' + " union all ".join(f"select '{k}' as \"check\", count(*) filter (where {c}) as n from kept" for k, c in FAULTS.items()) + ") where n > 0",
        "kept",
    )
    if "kept" in CTE
    else "",
    "feature_invariants": sql(" union all ".join(f"select '{c}' as invariant, count(*) filter (where {c} < 0) as n_bad from feat" for c in ("r2", "park_var", "rvol_5", "rvol_21", "rvol_63")), "feat"),
    "upsert_merge": sql(
        f"select ticker, trade_date, {r('case when day(trade_date) >= 15 then close * 2 else close end', 'close')}, case when day(trade_date) >= 15 then 'second' else 'first' end as source from bars",
        "bars",
    ),
    "monotonic_guard": sql(
        """select ticker, count(*) filter (where ticker != 'N' or day(trade_date) <= 10) as n_old, count(*) filter (where ticker != 'A' or day(trade_date) <= 10) as n_new, case when ticker = 'A' then 'guarded' else 'written' end as status from bars group by ticker""",
        "bars",
    ),
    "first_source": sql("select ticker, case when ticker = 'N' then 'second' else 'primary' end as source, count(*) as n, cast(sum(volume) as bigint) as volume from bars group by 1", "bars"),
    "normalized_frame": f"""with raw as (select 'R' as ticker, cast(l_shipdate as date) as trade_date, l_extendedprice as open, l_extendedprice + 1 as high, l_extendedprice - 1 as low,
      case when l_linenumber < 7 then l_extendedprice end as close, cast(round_even(l_quantity / 2, 0) as bigint) as volume, row_number() over (partition by cast(l_shipdate as date) order by {KEY} desc) as k from lineitem where l_returnflag = 'R')
      select ticker, trade_date, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('close', 'adj_close')}, volume from raw where k = 1""",
    "clean_bars": sql(f"select {BAR}, {r('log_return')} from clean", "clean"),
    "gap_report": sql(
        """select s.ticker, first_bar, last_bar, (select count(*) from cal where session_date between first_bar and least(last_bar, cutoff)) as expected_sessions, bars_present,
        (select count(*) from cal where session_date between first_bar and least(last_bar, cutoff)) - clean_rows as n_missing, n_non_session, n_partial, clean_rows from (
        select ticker, min(trade_date) as first_bar, max(trade_date) as last_bar, count(*) as bars_present, count(*) filter (where trade_date <= cutoff and dayofweek(trade_date) in (0, 6)) as n_non_session,
        count(*) filter (where trade_date > cutoff) as n_partial, count(*) filter (where trade_date <= cutoff and dayofweek(trade_date) between 1 and 5) as clean_rows, max(cutoff) as cutoff from bars, cut group by ticker) s""",
        "bars", "cal", "cut",
    ),
    "gap_dates": sql(
        """select s.ticker, session_date as missing_session from (select ticker, min(trade_date) as a, max(trade_date) as b from bars group by 1) s, cut join cal on true
        where session_date between a and least(b, cutoff) and not exists (select 1 from bars where bars.ticker = s.ticker and bars.trade_date = session_date)""",
        "bars", "cal", "cut",
    ),
    "session_bounds": sql("select cutoff, (select min(session_date) from cal where session_date > date '2001-10-12') as next_session from cut", "cal", "cut"),
    "telescoping": sql(f"select ticker, {r('sum(log_return)', 'sum_log_return')}, {r('ln(max_by(adj_close, trade_date) / min_by(adj_close, trade_date))', 'log_total')}, abs(coalesce(sum(log_return), 0) - ln(max_by(adj_close, trade_date) / min_by(adj_close, trade_date))) <= 1e-9 as telescopes from clean group by ticker", "clean"),
    "daily_features": sql(f"select ticker, trade_date, {', '.join(r(c) for c in FEATURES)} from feat", "feat"),
    "features_canary": sql("select ticker, count(*) as n_rows, count(rvol_63) as n_rvol_63, count(har_rv_m) as n_har_rv_m, count(*) filter (where gk_var < 0) as n_negative_gk from feat group by ticker", "feat"),
    "feature_cross_check": sql(" union all ".join(f"select '{c}' as \"column\", 0.0::double as max_abs_diff, true as nulls_agree, count({c}) as n_values, {r(f'avg({c})', 'mean_value')} from feat" for c in FEATURES), "feat"),
    "vix_features": sql(
        f"select trade_date, ticker, {r('gk_var')}, {r('vix_close')}, {r('vix_log_change')} from feat left join (select *, ln(vix_close) - ln(lag(vix_close) over (order by trade_date)) as vix_log_change from vix) using (trade_date)", "feat", "vix"
    ),
    "ewma_forecasts": sql(f"select ticker, trade_date, 'ewma_094' as model, {r('v', 'var_forecast')} from ewma where t >= 756", "ewma"),
    "ewma_live": sql(f"select ticker, last_date, 'ewma_094' as model, {r('var_forecast')} from ewma_last", "ewma_last"),
    "har_coefficients": sql(
        f"select c.ticker, cast(c.month as date) as month, trade_date as refit_date, n_train, {', '.join(r(f'b{k}') for k in range(4))}, {r('s2')} from har_coef c join har_rows h on h.ticker = c.ticker and h.t = c.t0", "har_coef", "har_rows"
    ),
    "har_forecasts": sql(f"select ticker, trade_date, 'har_rv' as model, {r('greatest(raw, 1e-8::double)', 'var_forecast')}, raw < 1e-8 as floored from har", "har"),
    "har_walk_forward": sql(f"select ticker, trade_date, 'har_rv' as model, {r('greatest(raw, 1e-8::double)', 'var_forecast')}, raw < 1e-8 as floored from har", "har"),
    "har_live": sql(f"select ticker, last_date, 'har_rv' as model, {r('greatest(raw, 1e-8::double)', 'var_forecast')} from har_last", "har_last"),
    "garch_filter_fixed": "",
    "ablation": sql(f"select ticker, model, n_obs, {r('qlike')}, {r('rmse_ann_vol_pct')}, eval_start, eval_end from abl", "abl"),
    "ablation_average": sql(
        f"select ticker, model, {r('qlike')}, {r('rmse_ann_vol_pct')}, qlike = min(qlike) over (partition by ticker) as best_qlike, rmse_ann_vol_pct = min(rmse_ann_vol_pct) over (partition by ticker) as best_rmse from abl_avg", "abl_avg"
    ),
    "ablation_span": sql("select count(distinct n_obs) = 1 as one_n_obs, count(distinct (eval_start, eval_end)) = 1 as one_span, count(distinct model) as n_models from abl", "abl"),
    "var_daily": sql(
        f"""select ticker, trade_date, model, level, {r('log_return')}, {r('var_threshold')}, breach, breach::int as breach_int, {r('-100 * var_threshold', 'neg_var_threshold')}, {r('100 * log_return', 'log_return_pct')},
        {r('case when breach then 100 * log_return end', 'breach_return')} from daily""",
        "daily",
    ),
    "var_breaches": sql(f"select ticker, model, level, trade_date, {r('log_return')}, {r('z * sqrt(var_forecast)', 'var_threshold')} from common, levels where log_return < -z * sqrt(var_forecast)", "common", "levels"),
    "var_coverage": sql(f"select {COVER} from cov", "cov"),
    "calibration_factors": sql(f"select ticker, cast(month as date) as month, first_date, {r('factor')} from factors", "factors"),
    "calibrated_live": sql(
        f"select l.ticker, l.trade_date, model || '_cal' as model, {r('any_value(var_forecast) * avg(r2) / avg(gk_var)', 'var_forecast')} from live l join feat on feat.ticker = l.ticker and feat.trade_date < l.trade_date and r2 is not null and gk_var > 0 where model = 'har_rv' group by 1, 2, 3",
        "live", "feat",
    ),
    "var_coverage_cal": sql(f"select {COVER} from cov_cal", "cov_cal"),
    "verdicts": sql(
        f"""select {r("g", "gk_rate_95")}, {r("o", "other_rate_95")}, gk_all_reject_95, {r("l", "least_rate_99")}, g >= 0.06 as underestimates, l > 0.01 as all_above_99, abs(g - 0.05) > abs(o - 0.05) as gk_deviates_more from (
        select avg(breach_rate) filter (where level = 95 and model = 'har_rv') as g, avg(breach_rate) filter (where level = 95 and model = 'ewma_094') as o, bool_and(kupiec_lr > 3.841458820694124) filter (where level = 95 and model = 'har_rv') as gk_all_reject_95,
        (select min(x) from (select avg(breach_rate) as x from cov where level = 99 group by model)) as l from cov)""",
        "cov",
    ),
    "coverage_summary": sql(
        f"select model, level, {r('avg(observed_breaches)', 'avg_breaches')}, {r('avg(breach_rate)', 'avg_rate')}, count(*) filter (where kupiec_lr > 3.841458820694124) as n_reject, count(*) as n_tickers from cov_cal group by 1, 2", "cov_cal"
    ),
    "report_window": sql("select min(n_obs) as n_obs, max(eval_start) as eval_start, min(eval_end) as eval_end from cov_cal", "cov_cal"),
    "forecast_vs_realized": sql(f"select ticker, trade_date, model, {r('var_forecast')}, {r('realized_gk_var')}, {r('f_vol', 'forecast_ann_vol_pct')}, {r('r_vol', 'realized_ann_vol_pct')} from versus", "versus"),
    "vol_regime": sql(
        f"""select ticker, trade_date, {r('100 * rvol_21', 'ann_vol_pct_21d')}, {r('pr', 'vol_percentile')}, case when pr < 0.25 then 'calm' when pr < 0.75 then 'normal' when pr < 0.95 then 'elevated' else 'stressed' end as regime
        from (select *, percent_rank() over (partition by ticker order by rvol_21) as pr from feat where rvol_21 is not null)""",
        "feat",
    ),
    "latest_forecast": sql(f"select ticker, model, x[1] as trade_date, {r('x[2]', 'var_forecast')}, x[3] as is_live, {r('100 * sqrt(252 * x[2])', 'ann_vol_pct')} from newest", "newest"),
    "cumulative_breaches": sql(
        f"""select ticker, model, level, trade_date, cast(sum(breach::int) over w as bigint) as cumulative_breaches, {r('count(*) over w * (100 - level) / 100.0::double', 'cumulative_expected')} from daily
        window w as (partition by ticker, model, level order by trade_date rows between unbounded preceding and current row)""",
        "daily",
    ),
    "dashboard_measures": sql(
        f"""select ticker, model, total_days, breaches, {r('rate', 'expected_rate_pct')}, {r('total_days * rate / 100', 'expected_breaches')}, {r('100.0::double * breaches / total_days', 'breach_rate_pct')}, {r('breaches - total_days * rate / 100', 'coverage_gap')}, {r('v', 'avg_daily_var_pct')}
        from (select ticker, model, count(*) as total_days, count(*) filter (where breach) as breaches, 100 - avg(distinct level) as rate, 100 * avg(var_threshold) as v from daily group by 1, 2)""",
        "daily",
    ),
    "coverage_measures": sql(f"select model, {r('max(kupiec_lr)', 'max_kupiec_lr')}, count(*) filter (where kupiec_lr > 3.841458820694124) as kupiec_rejections from cov group by 1", "cov"),
    "vol_measures": sql(f"select ticker, model, {r('avg(f_vol)', 'forecast_vol_pct')}, {r('avg(r_vol)', 'realized_vol_pct')} from versus group by 1, 2", "versus"),
    "data_age": sql("select max(x[1]) as latest_data_date, cast(date '2001-12-01' - max(x[1]) as int) as data_age_days from newest", "newest"),
    "dim_date": "select cast(d as date) as trade_date from generate_series(timestamp '1995-01-01', timestamp '2002-12-31', interval 1 day) t(d)",
    "dim_ticker_model": sql("select distinct 'ticker' as kind, ticker as value from daily union all select distinct 'model', model from daily", "daily"),
    "audit_metrics": sql(
        f"""select ticker, n_bars, first_bar, last_bar, e as expected_sessions, e - s as n_missing, n_special, n_zero_volume, {r('ratio', 'last_close_adj_ratio')}, {r('max_raw_move')}, {r('max_adj_move')}, n_jumps, {r('(e - s) / e::double', 'gap_rate')},
        {r('n_zero_volume / n_bars::double', 'zero_volume_rate')}, abs(ratio - 1) < 0.01 and n_jumps = 0 as adjustment_ok, (e - s) / e::double < 0.01 and (ticker = 'N' or n_zero_volume / n_bars::double < 0.01) and abs(ratio - 1) < 0.01 and n_jumps = 0 as go
        from (select *, (select count(*) from cal where session_date between first_bar and last_bar) as e from (
          select ticker, count(*) as n_bars, min(trade_date) as first_bar, max(trade_date) as last_bar, count(*) filter (where dayofweek(trade_date) between 1 and 5) as s, count(*) filter (where dayofweek(trade_date) in (0, 6)) as n_special,
          count(*) filter (where coalesce(volume, 0) = 0) as n_zero_volume, max_by(close / adj_close, trade_date) as ratio, max(raw_move) as max_raw_move, max(adj_move) as max_adj_move, count(*) filter (where raw_move > 0.35) as n_jumps from moves group by 1))""",
        "moves", "cal",
    ),
    "audit_actions": sql(
        f"""select a.ticker, a.ex_date, note, {r('max_move')}, coalesce(max_move < 0.35, false) as continuous from (values ('A', date '1996-03-10', 'bonus'), ('R', date '1997-06-02', 'split')) a(ticker, ex_date, note)
        left join (select ticker, ex_date, max(m) as max_move from (select b.ticker, ex_date, abs(ln(adj_close) - ln(lag(adj_close) over (partition by b.ticker, ex_date order by trade_date))) as m
          from bars b join (values ('A', date '1996-03-10'), ('R', date '1997-06-02')) x(ticker, ex_date) on x.ticker = b.ticker and trade_date between ex_date - 7 and ex_date + 7) group by 1, 2) s on s.ticker = a.ticker and s.ex_date = a.ex_date""",
        "bars",
    ),
    "canaries": sql(
        "select unnest(['telescoping', 'negative_gk', 'floored']) as canary, unnest([(select count(*) from (select ticker from clean group by ticker having abs(coalesce(sum(log_return), 0) - ln(max_by(adj_close, trade_date) / min_by(adj_close, trade_date))) > 1e-9)), (select count(*) from feat where gk_var < 0), (select count(*) from har where raw < 1e-8)]) as n", "clean", "feat", "har"
    ),
    "streamed_sessions": "select event_type as ticker, cast(ts as date) as trade_date, count(*) as n_ticks, round(max(value), 6) + 0.0 as high, round(min(value), 6) + 0.0 as low from events where cast(ts as date) < (select cast(max(ts) as date) from events) group by 1, 2",
}

cte(
    "spoiled",
    """select ticker, trade_date, case when day(trade_date) = 7 then -open else open end as open, high, case when day(trade_date) = 3 then high + 1 else low end as low,
    case when day(trade_date) = 11 then null else close end as close, adj_close, case when day(trade_date) = 13 then -1 else volume end as volume from bars""",
    "bars",
)
cte("twice", "select * from spoiled union all select * from spoiled where day(trade_date) = 17", "spoiled")
cte("kept", "select *, count(*) over (partition by ticker, trade_date) as copies from twice", "twice")
ORACLES["validation_violations"] = sql("select * from (" + " union all ".join(f"select '{k}' as \"check\", count(*) filter (where {c}) as n from kept" for k, c in FAULTS.items()) + ") where n > 0", "kept")

cte("eps", "select ticker, trade_date, t, 100 * log_return - 0.05::double as eps from ret", "ret")
cte(
    "garch",
    f"""select ticker, trade_date, t, eps, 400.0::double / (1 - 0.08::double - 0.85::double) as v from eps where t = 0
    union all select e.ticker, e.trade_date, e.t, e.eps, {GARCH_STEP.replace('eps', 'garch.eps').replace('* v', '* garch.v')} from garch join eps e on e.ticker = garch.ticker and e.t = garch.t + 1""",
    "eps",
)
ORACLES["garch_filter_fixed"] = sql(f"select ticker, trade_date, {r('v', 'variance_pct2')}, {r(GARCH_STEP, 'next_variance_pct2')} from garch", "garch")

cte("spoiled_clean", CTE["spoiled"][0].replace("from bars", "from clean"), "clean")
cte("twice_clean", "select * from spoiled_clean union all select * from spoiled_clean where day(trade_date) = 17", "spoiled_clean")
cte("kept_clean", "select *, count(*) over (partition by ticker, trade_date) as copies from twice_clean", "twice_clean")
ORACLES["clean_violations"] = sql("select * from (" + " union all ".join(f"select '{k}' as \"check\", count(*) filter (where {c}) as n from kept_clean" for k, c in FAULTS.items()) + ") where n > 0", "kept_clean")
cte("odd_fore", "select ticker, trade_date, model, case when day(trade_date) = 3 then -var_forecast when day(trade_date) != 5 then var_forecast end as v from settled", "settled")
cte("odd_twice", "select *, count(*) over (partition by ticker, trade_date, model) as copies from (select * from odd_fore union all select * from odd_fore where day(trade_date) = 17)", "odd_fore")
ORACLES["forecast_violations"] = sql(
    "select * from (" + " union all ".join(f"select '{k}' as \"check\", count(*) filter (where {c}) as n from odd_twice" for k, c in {"var_forecast_null": "v is null", "var_forecast_not_positive": "v <= 0", "duplicate_key": "copies > 1"}.items()) + ") where n > 0", "odd_twice"
)
_rules = {
    "forecasts": ("fore", {"var_forecast": "var_forecast > 0"}),
    "coverage": ("cov", {"level": "level in (95, 99)", "observed": "observed_breaches between 0 and n_obs", "rate": "breach_rate between 0 and 1", "kupiec_lr": "kupiec_lr >= 0", "span": "eval_start <= eval_end"}),
    "breaches": ("hits", {"threshold": "var_threshold > 0", "breach": "log_return < -var_threshold"}),
    "ablation": ("abl", {"n_obs": "n_obs > 0", "qlike": "qlike >= 0", "rmse": "rmse_ann_vol_pct >= 0", "span": "eval_start <= eval_end"}),
}
cte("hits", "select log_return, z * sqrt(var_forecast) as var_threshold from common, levels where log_return < -z * sqrt(var_forecast)", "common", "levels")
ORACLES["stored_invariants"] = sql(" union all ".join(f"select '{name}' as name, '{k}' as invariant, count(*) filter (where not coalesce({c}, true)) as n_bad from {t}" for name, (t, rules) in _rules.items() for k, c in rules.items()), "fore", "cov", "hits", "abl")
ORACLES["modeled_tickers"] = sql("select ticker, count(*) as n from bars group by 1", "bars")
ORACLES["bars_of_ticker"] = sql(f"select {BAR} from bars where ticker = 'R'", "bars")
ORACLES["wide_frame"] = f"""with raw as (select 'A' as ticker, cast(l_shipdate as date) as trade_date, l_extendedprice as open, l_extendedprice + 1 as high, l_extendedprice - 1 as low, l_extendedprice as close,
  l_extendedprice / 2 as adj_close, cast(round_even(l_quantity / 2, 0) as bigint) as volume, row_number() over (partition by cast(l_shipdate as date) order by {KEY} desc) as k from lineitem where l_returnflag = 'A')
  select ticker, trade_date, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('adj_close')}, volume from raw where k = 1"""
ORACLES["forecast_totals"] = sql("select model, count(*) filter (where not is_live) as n_settled, count(*) filter (where is_live) as n_live, max(trade_date) as last_date from fore group by 1", "fore")
ORACLES["har_result_records"] = sql(
    """select ticker, 'har_rv' as model, (select count(*) from har where har.ticker = n.ticker) as n_forecasts, n_refits, (select count(*) from har where har.ticker = n.ticker and raw < 1e-8) as n_floored, 0 as n_skipped, n_dropped, 1 as n_live
    from (select f.ticker, count(*) as n_refits, max((select count(*) from har_rows h where h.ticker = f.ticker and h.t <= f.t0 - 2 and x1 is not null and x2 is not null and x3 is not null and target <= 0)) as n_dropped from har_first f group by 1) n""",
    "har", "har_first", "har_rows",
)
ORACLES["nightly_tables"] = sql(
    """select 'raw' as name, count(*) as n_rows, count(*) as n_keys, max(trade_date) as last_date from bars union all select 'clean', count(*), count(*), max(trade_date) from clean
    union all select 'features', count(*), count(*), max(trade_date) from feat union all select 'forecasts', count(*), count(*), max(trade_date) from settled""",
    "bars", "clean", "feat", "settled",
)
ORACLES["increment_path"] = sql(
    """select ticker, case when ticker = 'N' then 'guarded' else 'written' end as status, 'trades' as source, count(*) filter (where ticker != 'N' or trade_date <= date '2001-08-31') as n_landed,
    count(*) filter (where ticker != 'N' or trade_date <= date '2001-08-31' or trade_date >= date '2001-09-28' - 13) as n_raw, count(*) filter (where ticker = 'N' and trade_date >= date '2001-09-28' - 13) as n_increment
    from bars where trade_date <= date '2001-09-28' group by ticker""",
    "bars",
)
ORACLES["replayed"] = sql("select 'first' as run, 0 as before, count(*) as upserted, count(*) as after, count(*) as new from bars union all select 'second', count(*), count(*), count(*), 0 from bars", "bars")
ORACLES["coverage_view"] = sql(f"select {COVER}, (kupiec_lr > 3.841458820694124)::int as reject_int from cov", "cov")
