"""All queries of the repository."""

import sys

from pyspark import cloudpickle

import workload
from workload import catalogue, clustering, matrix, signals, sources  # noqa: F401
from workload.common import ORACLE, QUERIES  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[workload.__name__])
