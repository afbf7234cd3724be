"""A run as an ordered dict of named stages, each a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.operators import analytics, charts, cleaning, exports, features, resample, trajectories
from barloom.sources import bars as source
from barloom.sources.sinks import write_table

Stage = Callable[[DataFrame], DataFrame]


def feature_table(bars: DataFrame, settings: Settings | None = None, seconds: int = 60) -> DataFrame:
    """Cleaned bars on a grid of ``seconds`` with all features and states."""
    s = settings or Settings()
    grid = resample.resample(cleaning.clean(bars, s.cleaning), seconds)
    return features.depth_resilience_balance(features.engineer(grid))


def stages(settings: Settings | None = None, seconds: int = 60) -> dict[str, Stage]:
    s = settings or Settings()
    return {
        "clean": lambda d: cleaning.clean(d, s.cleaning), "resample": lambda d: resample.resample(d, seconds), "features": features.engineer,
        "balance": features.depth_resilience_balance,
    }


class Run:
    """Lazy stages over bars; the feature table is persisted once for all summaries."""

    def __init__(self, bars: DataFrame, settings: Settings | None = None, seconds: int = 60, names: list[str] | None = None):
        self.settings, self.bars = settings or Settings(), bars
        every = stages(self.settings, seconds)
        unknown = set(names or ()) - set(every)
        if unknown:
            raise ValueError(f"no such stages: {sorted(unknown)}")
        df = bars
        for k, f in every.items():
            if names is None or k in names:
                df = df.transform(f)
        self.table = df.persist()

    def tables(self) -> dict[str, DataFrame]:
        out = exports.export_tables(self.table)
        out["microstructure_summary"] = analytics.contract_analysis(self.table, self.settings.surges)
        out["cleaning_stats"] = cleaning.cleaning_stats(self.bars, self.settings.cleaning)
        out["trajectories"] = trajectories.signatures(self.table, self.settings.alignment)
        return out

    def charts(self) -> dict[str, DataFrame]:
        return charts.chart_data(self.table)

    def write(self, folder: str, kind: str = "parquet", figures: bool = True) -> None:
        for name, df in (self.tables() | (self.charts() if figures else {})).items():
            write_table(df, f"{folder}/{name}", kind)


def main(argv: list[str] | None = None) -> None:
    """Command line: ``python -m barloom.plans.run ROOT --output FOLDER``."""
    import argparse

    from barloom.config import load_settings

    a = argparse.ArgumentParser(description=main.__doc__)
    a.add_argument("root")
    a.add_argument("--output", default="output")
    a.add_argument("--config")
    a.add_argument("--categories", nargs="*")
    a.add_argument("--min-observations", type=int, default=50)
    a.add_argument("--max-contracts", type=int)
    a.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    a.add_argument("--no-figures", action="store_true")
    args = a.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    bars = source.read_bars(spark, args.root, args.categories, args.min_observations)
    if args.max_contracts:
        chosen = bars.select("contract_id").distinct().orderBy("contract_id").limit(args.max_contracts)
        bars = bars.join(F.broadcast(chosen), "contract_id", "left_semi")
    Run(bars, load_settings(args.config)).write(args.output, args.format, not args.no_figures)


if __name__ == "__main__":
    main()
