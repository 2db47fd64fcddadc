"""weftline: text-corpus analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
