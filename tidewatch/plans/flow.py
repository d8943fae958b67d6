"""The stages of a run, from trades to forecasts, as lazy frames over the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, features, garch, har, recursions, walkforward
from tidewatch.sources import market
from tidewatch.sources.storage import stage

#: Trees of the boosted models, as in the reference.
TREES = 300
#: The moment of the run: bars of later sessions are partial.
AS_OF = "2001-10-17 12:00:00"


@dataclass
class Flow:
    """Frames by stage; each is a plan that Catalyst sees whole, so a query reads only the columns it needs."""

    spark: SparkSession
    sf_dir: str
    as_of: str = AS_OF
    #: Whether clean bars are written once, for queries with several branches on them; else all is one lazy plan.
    staged: bool = False
    #: Whether forecasts are those of all five models, written once, or of the two that SQL can say.
    all_models: bool = False
    trees: int = TREES

    @cached_property
    def raw(self) -> DataFrame:
        return market.bars_from_trades(market.table(self.spark, self.sf_dir, "lineitem"))

    @cached_property
    def calendar(self) -> DataFrame:
        return market.weekday_calendar(self.spark)

    @cached_property
    def vix(self) -> DataFrame:
        return market.volatility_index(market.table(self.spark, self.sf_dir, "orders"))

    @cached_property
    def clean(self) -> DataFrame:
        rows = cleaning.clean_bars(self.raw, self.calendar, self.as_of)
        return stage(rows, "clean") if self.staged else rows

    @cached_property
    def features(self) -> DataFrame:
        rows = features.build(self.clean)
        return stage(rows, "features") if self.staged else rows

    @cached_property
    def next_session(self) -> DataFrame:
        return self.after_last(self.clean, self.calendar)

    @staticmethod
    def after_last(clean: DataFrame, calendar: DataFrame) -> DataFrame:
        """(ticker, last_date, trade_date): per ticker the session after its last clean bar."""
        last = clean.groupBy("ticker").agg(F.max("trade_date").alias("last_date"))
        days = last.select("ticker", "last_date", F.explode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", 14))).alias("session_date"))
        near = days.join(F.broadcast(calendar.select("session_date")), "session_date", "left_semi")
        return near.groupBy("ticker", "last_date").agg(F.min("session_date").alias("trade_date"))

    @cached_property
    def settled(self) -> DataFrame:
        """Walk-forward forecasts of the models that need no Python."""
        har_rows = har.forecasts(self.features).drop("floored")
        return recursions.ewma_forecasts(self.clean).unionByName(har_rows).withColumn("is_live", F.lit(False))

    @cached_property
    def fitted(self) -> DataFrame:
        """Settled and live forecasts of the models that are fitted in Python: GARCH and both boosted ones."""
        rows = garch.forecasts(self.clean, garch.effective(garch.refits(self.clean))).withColumn("is_live", F.col("trade_date").isNull())
        rows = rows.select("ticker", "trade_date", "model", "var_forecast", "is_live")
        for tag, frame, columns in (("lgbm", self.features, features.TREE_COLUMNS), ("lgbm_vix", features.with_vix(self.features, self.vix), features.TREE_COLUMNS + features.VIX_COLUMNS)):
            found = walkforward.walk_forward(frame, columns, walkforward.boosted_factory(trees=self.trees), tag).where("not skipped")
            rows = rows.unionByName(found.select("ticker", "trade_date", "model", "var_forecast", "is_live"))
        after = F.broadcast(self.next_session.select("ticker", F.col("trade_date").alias("next")))
        dated = rows.where("is_live").join(after, "ticker").select("ticker", F.col("next").alias("trade_date"), "model", "var_forecast", "is_live")
        return stage(rows.where("not is_live").unionByName(dated), "fitted")

    @cached_property
    def live(self) -> DataFrame:
        """Their forecasts of each ticker's next session."""
        rows = recursions.ewma_live(self.clean).unionByName(har.live(self.features))
        out = rows.join(F.broadcast(self.next_session), ["ticker", "last_date"])
        out = out.select("ticker", "trade_date", "model", "var_forecast", F.lit(True).alias("is_live"))
        return out.unionByName(self.fitted.where("is_live")) if self.all_models else out

    @cached_property
    def forecasts(self) -> DataFrame:
        """Of both kinds of models: settled rows, and live ones."""
        rows = self.settled.unionByName(self.live)
        return rows.unionByName(self.fitted.where("not is_live")) if self.all_models else rows
