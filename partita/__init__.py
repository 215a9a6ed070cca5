"""partita: batches of printed piano pages and the scores read from them, on Spark."""

import sys

from pyspark import cloudpickle

# Functions for Spark's Python workers travel with their code: no worker needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
