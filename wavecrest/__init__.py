"""Spark-native analytics for multichannel recordings and text corpora.

Functions of this package that run inside Spark tasks are pickled by value, so
executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
