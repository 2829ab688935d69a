"""shelfspark: a Spark-first engine for product search, ranking evaluation and catalog data preparation.

Every operator takes and returns DataFrames.  Functions that run in Python workers are pickled by value, so a
cluster needs the package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
