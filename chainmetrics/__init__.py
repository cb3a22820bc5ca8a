"""Weekly activity metrics of a two-runtime blockchain network, as Spark DataFrames."""

from chainmetrics.functions.timeops import AsOf
from chainmetrics.sources.tables import Sources

__all__ = ["AsOf", "Sources"]
