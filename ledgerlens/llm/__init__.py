"""Operators for preparing training data.

Functions of this subpackage travel to the executors by value, so a cluster
needs only numpy, pyarrow and the tokenizer library, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
