"""Document review, citation checking and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so a worker need not have this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
