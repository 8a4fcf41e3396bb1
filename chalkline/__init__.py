"""Chalkline: football contest, usage and betting-market analytics as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

from chalkline.session import build_session

# Batch functions travel to the executors by value, so the workers need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
