"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; it can be removed whole.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
