"""The nightly run: every stage in order, stored, with canaries that stop it."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, evaluate, features, garch, har, recursions, risk, validation, walkforward
from tidewatch.sources import ingest, market
from tidewatch.sources.storage import Store, shared_folder

from .flow import AS_OF, TREES, Flow

KEYS = ["ticker", "trade_date", "model"]


class CanaryError(RuntimeError):
    pass


def canaries(clean: DataFrame, feats: DataFrame, har_rows: DataFrame, in_force: DataFrame | None = None, walked: list[DataFrame] | None = None) -> DataFrame:
    """(canary, n): counts that must all be zero; ``in_force`` are GARCH parameters, ``walked`` results of walk-forwards."""
    floored = har_rows.where("floored").select("ticker")
    for rows in walked or []:
        floored = floored.unionByName(rows.where("floored").select("ticker"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("canary"), "n")
    out = n(cleaning.telescoping(clean).where("not telescopes"), "telescoping").unionByName(n(feats.where("gk_var < 0"), "negative_gk")).unionByName(n(floored, "floored"))
    if in_force is not None:
        out = out.unionByName(n(in_force.where("fallback"), "garch_fallback")).unionByName(n(in_force.where("unconverged"), "garch_unconverged"))
    return out


def enforce(table: DataFrame) -> None:
    """Raises with the names of the canaries that aren't zero."""
    bad = [(r["canary"], r["n"]) for r in table.where("n > 0").orderBy("canary").collect()]
    if bad:
        raise CanaryError(f"canaries: {bad}")


@dataclass
class Night:
    """Seconds by stage, what each stage wrote, the intake by ticker and the canaries."""

    seconds: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    intake: DataFrame | None = None
    canaries: DataFrame | None = None


def totals(forecasts: DataFrame) -> DataFrame:
    """Settled and live forecasts by model, and their last dates."""
    return forecasts.groupBy("model").agg(F.count_if(~F.col("is_live")).alias("n_settled"), F.count_if("is_live").alias("n_live"), F.max("trade_date").alias("last_date"))


def run(spark: SparkSession, store: Store, raw: DataFrame | None, calendar: DataFrame, vix: DataFrame, as_of: str = AS_OF, trees: int = TREES, strict: bool = True, intake=None, boosted: tuple[str, ...] = ("lgbm", "lgbm_vix")) -> Night:
    """Takes in ``raw`` bars (or calls ``intake(store)``, which returns its results by ticker), validates, cleans, builds features, forecasts with all five models, evaluates and stores.

    Every stage after the intake reads the store, so that a night that brings a few days
    works on the whole history.  ``boosted`` names the boosted models that are fitted
    beside EWMA, GARCH and HAR.
    """
    night = Night()

    def stage(name: str, work) -> None:
        began = time.time()
        work()
        night.seconds[name] = round(time.time() - began, 2)

    def take_in() -> None:
        if intake:
            night.intake = intake(store)
        else:
            night.rows["raw"] = ingest.load_raw(store, raw, "trades", "raw")

    def clean() -> None:
        bars = market.modeled(store.read("raw")).select(*market.COLUMNS)
        rows = validation.validate_clean(cleaning.clean_bars(bars, calendar, as_of), "clean")
        night.rows["clean"] = store.upsert("clean", rows, ["ticker", "trade_date"])

    def feature_rows() -> None:
        night.rows["features"] = store.upsert("features", features.build(store.read("clean")), ["ticker", "trade_date"])

    def put(rows: DataFrame, is_live: bool) -> None:
        rows = validation.validate_forecasts(rows.select("ticker", "trade_date", "model", "var_forecast"), "forecasts")
        name = "live_forecasts" if is_live else "new_forecasts"
        night.rows[name] = night.rows.get(name, 0) + store.upsert("forecasts", rows.withColumn("is_live", F.lit(is_live)), KEYS)

    def dated(rows: DataFrame) -> DataFrame:
        """Live rows with the date of the session after the ticker's last one."""
        after = Flow.after_last(store.read("clean"), calendar).select("ticker", F.col("trade_date").alias("next"))
        return rows.drop("trade_date").join(after, "ticker").withColumnRenamed("next", "trade_date")

    def baselines() -> None:
        bars, feats = store.read("clean"), store.read("features")
        put(recursions.ewma_forecasts(bars).unionByName(har.forecasts(feats).drop("floored")), False)
        put(dated(recursions.ewma_live(bars).unionByName(har.live(feats))), True)
        night.rows["garch_params"] = store.replace("garch_params", garch.effective(garch.refits(bars)))
        rows = garch.forecasts(bars, store.read("garch_params"))
        put(rows.where("trade_date is not null"), False)
        put(dated(rows.where("trade_date is null")), True)

    def walked() -> None:
        base = store.read("features")
        for tag, frame, columns in (("lgbm", base, features.TREE_COLUMNS), ("lgbm_vix", features.with_vix(base, vix), features.TREE_COLUMNS + features.VIX_COLUMNS)):
            if tag not in boosted:
                continue
            store.replace(tag, walkforward.walk_forward(frame, columns, walkforward.boosted_factory(trees=trees), tag))
            rows = store.read(tag).where("not skipped")
            put(rows.where("not is_live"), False)
            put(dated(rows.where("is_live")), True)

    def scores() -> None:
        fore, feats, bars = store.read("forecasts"), store.read("features"), store.read("clean")
        night.rows["ablation"] = store.upsert("ablation", evaluate.ablation(fore, feats), ["ticker", "model"])
        rows = risk.common_returns(fore, bars)
        night.rows |= store.replace_all({"coverage": risk.with_p(risk.backtest(fore, bars, feats)), "breaches": risk.breaches(rows)})
        if risk.trigger(store.read("coverage")).first()[0]:
            put(risk.calibrated(rows, feats), False)
            put(risk.calibrated_live(fore.where("is_live"), feats), True)

    def gate() -> None:
        night.canaries = canaries(store.read("clean"), store.read("features"), har.forecasts(store.read("features")), store.read("garch_params"), [store.read(t) for t in boosted])
        if strict:
            enforce(night.canaries)

    for name, work in (("raw", take_in), ("clean", clean), ("features", feature_rows), ("baselines", baselines), ("trees", walked), ("evaluate", scores), ("gate", gate)):
        stage(name, work)
    return night


def two_nights(spark: SparkSession, sf_dir: str, **options) -> Store:
    """A store after two nights over the tables' trades, the second with a batch that overlaps the first's."""
    flow, cut = Flow(spark, sf_dir), F.lit("2001-09-01").cast("date")
    store = Store(spark, f"{shared_folder(spark)}/tidewatch-nights-{uuid.uuid4().hex}")
    for batch, as_of in ((flow.raw.where(F.col("trade_date") < cut), "2001-09-01 12:00:00"), (flow.raw.where(F.col("trade_date") >= F.date_sub(cut, 20)), AS_OF)):
        run(spark, store, batch, flow.calendar, flow.vix, as_of, strict=False, **options)
    return store


def tables(store: Store) -> DataFrame:
    """Rows, keys and last date of the stored tables, of EWMA's and HAR's settled forecasts among them."""
    out = None
    for name, keys in (("raw", KEYS[:2]), ("clean", KEYS[:2]), ("features", KEYS[:2]), ("forecasts", KEYS)):
        rows = store.read(name)
        if name == "forecasts":
            rows = rows.where("not is_live and model in ('ewma_094', 'har_rv')")
        part = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.count_distinct(*keys).alias("n_keys"), F.max("trade_date").alias("last_date"))
        out = part if out is None else out.unionByName(part)
    return out
