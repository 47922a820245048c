"""Synthetic populations and opinion backtests as Spark DataFrame functions."""
