"""tickloom: market-microstructure analytics as plain Spark DataFrame jobs.

Layers, from the bottom up:

* ``sources``    table schemas, readers, writers and generated tables
* ``functions``  column builders: time rasters, prices, spreads, significance
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      whole jobs composed of operators
* ``jobs``       the command line around the plans
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
