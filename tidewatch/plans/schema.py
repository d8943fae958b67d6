"""The stored tables: columns, keys, constraints and layout, and the ordered migrations that make them."""

from __future__ import annotations

from dataclasses import dataclass

from tidewatch.operators.features import TARGET, TREE_COLUMNS
from tidewatch.operators.validation import INVARIANTS

BARS = "ticker string, trade_date date, open double, high double, low double, close double, adj_close double, volume bigint"


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the key, and the columns by which files are sorted, so that statistics skip them."""

    columns: str
    keys: tuple[str, ...]
    sorted_by: tuple[str, ...] = ("ticker", "trade_date")


TABLES = {
    "raw": Table(f"{BARS}, source string, loaded_at timestamp", ("ticker", "trade_date")),
    "clean": Table(f"{BARS}, log_return double, loaded_at timestamp", ("ticker", "trade_date")),
    "features": Table(
        "ticker string, trade_date date, log_return double, " + ", ".join(f"{c} double" for c in dict.fromkeys((*TREE_COLUMNS, TARGET))) + ", loaded_at timestamp",
        ("ticker", "trade_date"),
    ),
    "forecasts": Table("ticker string, trade_date date, model string, var_forecast double, is_live boolean, loaded_at timestamp", ("ticker", "trade_date", "model"), ("model", "ticker", "trade_date")),
    "ablation": Table("ticker string, model string, n_obs bigint, qlike double, rmse_ann_vol_pct double, eval_start date, eval_end date, loaded_at timestamp", ("ticker", "model"), ("model", "ticker")),
    "coverage": Table(
        "ticker string, model string, level int, n_obs bigint, expected_breaches double, observed_breaches bigint, breach_rate double, kupiec_lr double, kupiec_p double, kupiec_reject boolean, eval_start date, eval_end date",
        ("ticker", "model", "level"), ("model", "ticker"),
    ),
    "breaches": Table("ticker string, model string, level int, trade_date date, log_return double, var_threshold double", ("ticker", "model", "level", "trade_date"), ("model", "ticker", "trade_date")),
}


def migrations() -> dict[str, str]:
    """Ordered statements: each table, then a view of the violations of each constrained table."""
    out = {}
    for i, (name, t) in enumerate(TABLES.items(), 1):
        dated = "partitioned by (month string)" if "trade_date" in t.columns else ""
        out[f"{i:03d}_{name}"] = f"create table if not exists {{database}}.{name} ({t.columns}) using parquet {dated}"
    for i, (name, rules) in enumerate(INVARIANTS.items(), len(TABLES) + 1):
        cases = " union all ".join(f"select '{k}' as invariant, count_if(not coalesce({cond}, true)) as n_bad from {{database}}.{name}" for k, cond in rules.items())
        out[f"{i:03d}_{name}_violations"] = f"create or replace view {{database}}.{name}_violations as {cases}"
    return out
