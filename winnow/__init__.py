"""Curation and analytics of large image, vector and text collections on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the code they need, so the package has to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
