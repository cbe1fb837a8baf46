"""codeloom: code and document graphs as Spark DataFrames.

A graph is two tables, ``nodes`` and ``edges``.  Every operator takes
DataFrames and returns a DataFrame, so Catalyst sees the whole plan.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so a cluster needs
# no copy of it on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
