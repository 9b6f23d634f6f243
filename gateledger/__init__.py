"""gateledger: policy decisions, content gates and sealed ledgers as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the small task-side helpers with each job, so executors need no copy of
# the package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
