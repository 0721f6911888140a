"""Spatio-temporal incident risk on Spark: panels of grid cells and months, hierarchical Poisson forecasts, backtests and settlement."""
