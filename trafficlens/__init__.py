"""Anomalies in hourly page traffic, as PySpark DataFrame plans.

Every operator takes and returns DataFrames and stays lazy; pages and windows
are grouping keys, never driver loops. See README.md for the layout.
"""

from trafficlens.session import configure

__all__ = ["configure"]
