"""File-provenance analytics on Spark: evidence, rules, lineage matching and verdicts over whole corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their jobs, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
