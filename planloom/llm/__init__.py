"""Operators for preparing training data, one module each; nothing else in the library imports this subpackage.

Functions that run in tasks are sent to them by value, so executors need NumPy, pyarrow and the libraries that an operator
names, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
