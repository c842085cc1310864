"""cairnwork: census, fact-graph and relational analytics expressed on Spark DataFrames."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
