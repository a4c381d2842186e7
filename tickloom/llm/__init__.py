"""Operators of a training-data pipeline: deduplication, packing, formatting, decontamination, search, scans,
quality selection, similarity joins and token-id files. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
