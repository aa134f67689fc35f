"""tillcast: store-by-day panel features, splits, metrics and forecasting
jobs on Spark DataFrames."""

__version__ = "0.1.0"
