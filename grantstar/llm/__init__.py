"""Operators for training data: quality, duplicates, tokens, mixing, safety.

Nothing else in the library imports this package. Its task functions travel with the job by value, so
workers need the public libraries only, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
