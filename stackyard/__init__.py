"""stackyard: warehouse-side data operators on Spark DataFrames.

Every operator is a function from DataFrame(s) to a DataFrame (or a Column
expression) built from Spark SQL built-ins, so Catalyst plans it and the
work runs on executors.  See README.md for the operator map.
"""

__version__ = "0.1.0"

# Functions that run inside Python workers (mapInPandas / applyInPandas
# bodies) are shipped by value, so executors need no copy of this package.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
