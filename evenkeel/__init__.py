"""evenkeel: Spark jobs that measure how stable categorical decisions are under rewording.

Trials come in as rows; exact distances, loss bounds, gates, resampling statistics,
histories, audits and published tables come out, all as DataFrames.
"""

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
