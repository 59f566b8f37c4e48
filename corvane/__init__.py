"""corvane: retrieval, knowledge-graph and corpus analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so these need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
