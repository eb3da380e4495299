"""Table profiling, semantic metrics and KPIs as Spark DataFrames."""

from lakegauge.dataset import Dataset
from lakegauge.operators.profile import Profile

__all__ = ["Dataset", "Profile"]
