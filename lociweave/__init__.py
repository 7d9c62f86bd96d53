"""Population-variant analytics on Spark: operators over DataFrames, with Arrow kernels where SQL cannot express the semantics.

Functions that run on executors are shipped by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
