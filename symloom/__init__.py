"""Analytics over source-code property graphs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package reach Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
