"""metricloom: metric-space analytics and similarity search as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
