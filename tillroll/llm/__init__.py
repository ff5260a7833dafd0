"""Operators for preparing training data for language models. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
