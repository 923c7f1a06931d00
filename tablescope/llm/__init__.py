"""Operators that prepare text corpora for training language models.

Functions that run in Python workers are sent with the task, so executors need no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
