"""lakepipe: a small, lazy, immutable dataframe API that plans and runs on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lakepipe.frame import DataFrame, GroupedDataFrame  # noqa: E402
from lakepipe.operators.partitioning import EvenPartitionSpec, HashPartitionSpec, RangePartitionSpec, UserDefinedPartitionSpec  # noqa: E402
from lakepipe.session import GlobalContext, Session  # noqa: E402

__all__ = [
    "DataFrame",
    "EvenPartitionSpec",
    "GlobalContext",
    "GroupedDataFrame",
    "HashPartitionSpec",
    "RangePartitionSpec",
    "Session",
    "UserDefinedPartitionSpec",
]
