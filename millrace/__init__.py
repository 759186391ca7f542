"""millrace: Spark-native dataset curation and evaluation analytics."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from millrace.session import build_session

__all__ = ["build_session"]

# Functions go to executors by value, so that these need not have this library installed.
register_pickle_by_value(sys.modules[__name__])
