"""leafscan: page-to-text analytics and corpus preparation as Spark DataFrame pipelines."""

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
