"""terralith: place search, spatial analytics and data preparation on Apache Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to executors by value: workers need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
