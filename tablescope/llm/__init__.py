"""Operators for building training corpora: filters, scans, extraction, near-duplicates, packing."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
