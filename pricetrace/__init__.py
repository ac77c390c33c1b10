"""Spark DataFrame operators that trace monthly price moves back to the news behind them."""
