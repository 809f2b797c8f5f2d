"""Event analytics on Spark: cleaning, classification, statistics and entity work as DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions travel to the Python workers by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
