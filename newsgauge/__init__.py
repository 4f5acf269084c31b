"""newsgauge: financial-news sentiment analytics as plain PySpark functions.

Every operator is a function ``DataFrame -> DataFrame`` or a ``Column`` builder, so Catalyst sees one
declarative plan; the incremental jobs in :mod:`newsgauge.streaming` are Structured Streaming queries.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
