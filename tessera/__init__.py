"""Signals from many noisy feeds of dated text: DataFrame operators for Spark."""
