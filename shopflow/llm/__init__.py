"""Operators for building language-model training data.

Each module holds one operator with its own interface; ``catalog`` maps the
registered query names to them.  Nothing outside this package imports it
except the entry module, which does so only when the package is present.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the code they use, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
