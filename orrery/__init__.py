"""Document-landscape analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so a cluster needs no
# install of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
