"""vecloom: feature-vector analytics and clustering as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Kernels that run inside Arrow functions travel with the job, so executors
# need no separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
