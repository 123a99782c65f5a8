"""Operators for large training-text pipelines.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with what they use, so that this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
