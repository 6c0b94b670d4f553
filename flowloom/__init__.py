"""Flow analytics on PySpark: DataFrame-to-DataFrame operators for building
labelled network-flow datasets, plus graph, clustering, classifier and
question-answer shaping jobs."""

import sys

from pyspark import cloudpickle

from flowloom.config import Settings

# Functions of this package that run inside tasks travel with the job, so
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
