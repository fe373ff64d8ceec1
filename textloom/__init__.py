"""Text analytics and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
