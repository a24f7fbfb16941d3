"""Operators that prepare text for training language models, one module each."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
