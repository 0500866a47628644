"""Series derived from the given tables; the inputs of every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DAILY, AuditConfig
from tidewatch.functions.calendar import add_calendar
from tidewatch.operators.features import densify, prepared, rollup
from tidewatch.operators.predict import seasonal_naive
from tidewatch.operators.score import audit_rows, score
from tidewatch.operators.sequence import index_grid
from tidewatch.operators.split import assign_period, split_spec
from tidewatch.session import prepare, stage_table
from tidewatch.sources.lines import table_lines

DK = ["l_returnflag", "l_linestatus"]
HK = ["event_type"]

#: hourly series with six-hour seasons, so that every lookup level is used
BANDED = AuditConfig(season=("band", "is_weekend"), fallback="day", lags=(1, 24, 168), cooldown_hours=3.0)


_staged: dict[tuple, DataFrame] = {}


def clear() -> None:
    """Forget staged series, so that the next query starts from the tables again."""
    _staged.clear()


def once(name: str, spark: SparkSession, sf: str, keys: list[str], make, stage: bool = True):
    """Stage a derived table once per session; later queries read the files."""
    at = (spark.sparkContext.applicationId, name, sf, *keys)
    if at not in _staged:
        _staged[at] = stage_table(make(), name) if stage else make()
    return _staged[at]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def hourly(spark: SparkSession, sf: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    rolled = lambda: rollup(table(spark, sf, "events"), "ts", "value", "hour", "sum", keys)
    return once("hourly", spark, sf, keys, lambda: densify(rolled(), "hour", keys, common_range=True))


def daily(spark: SparkSession, sf: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    rolled = lambda: rollup(
        table(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "day", "sum", keys
    )
    return once("daily", spark, sf, keys, lambda: densify(rolled(), "day", keys, common_range=True))


def split_series(series: DataFrame, cfg: AuditConfig, keys: list[str], step: int) -> DataFrame:
    full = prepared(series, "y", cfg.lags, keys, step, complete=True)
    spec = split_spec(full, keys, "ts", (cfg.fit_ratio, cfg.calib_ratio))
    return assign_period(full, spec, keys)


def with_naive(split: DataFrame, cfg: AuditConfig, keys: list[str]) -> DataFrame:
    """Calibration and test rows with season columns and the naive prediction."""
    cols = tuple(dict.fromkeys((*cfg.season, cfg.fallback)))
    d = add_calendar(audit_rows(split, keys), "ts", cols)
    return seasonal_naive(d, "y", cfg.season, keys)


def scored(audit: DataFrame, cfg: AuditConfig, keys: list[str], pred: str = "pred_naive") -> DataFrame:
    return score(audit, "y", cfg.season, cfg.fallback, pred, cfg.threshold_q, cfg.min_n, keys)


def daily_split(spark: SparkSession, sf: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    make = lambda: split_series(daily(spark, sf, keys), DAILY, keys, 86400)
    return once("daily-split", spark, sf, keys, make)


def daily_audit(spark: SparkSession, sf: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    make = lambda: with_naive(daily_split(spark, sf, keys), DAILY, keys)
    return once("daily-audit", spark, sf, keys, make)


def daily_scored(spark: SparkSession, sf: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    make = lambda: scored(daily_audit(spark, sf, keys), DAILY, keys)
    return once("daily-scored", spark, sf, keys, make)


def hourly_banded(spark: SparkSession, sf: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []

    def make() -> DataFrame:
        split = stage_table(split_series(hourly(spark, sf, keys), BANDED, keys, 3600), "hourly-split")
        return scored(stage_table(with_naive(split, BANDED, keys), "hourly-audit"), BANDED, keys)

    return once("hourly-scored", spark, sf, keys, make)


def indexed_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return index_grid(hourly(spark, sf), [], "ts", 3600)


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the tables have them."""
    cols = {
        f.name: F.col(f.name).cast("timestamp_ntz")
        for f in df.schema.fields
        if f.dataType.typeName() == "timestamp"
    }
    return df.withColumns(cols) if cols else df


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as a CSV text with a header line."""
    cols = {
        "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
        "o_custkey": F.col("o_custkey"),
        "o_orderkey": F.col("o_orderkey"),
        "o_orderpriority": F.col("o_orderpriority"),
    }
    make = lambda: table_lines(table(spark, sf, "orders"), cols, "o_orderkey")
    return once("order-lines", spark, sf, [], make)


def customer_lines(spark: SparkSession, sf: str) -> DataFrame:
    cols = {
        "c_name": F.col("c_name"),
        "c_acctbal": F.col("c_acctbal").cast("decimal(18,2)"),
        "c_custkey": F.col("c_custkey"),
    }
    return table_lines(table(spark, sf, "customer"), cols, "c_custkey")
