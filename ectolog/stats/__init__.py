"""Statistical operators: Spark reduces the data, small matrices are solved here."""

from pyspark import cloudpickle

from ectolog.stats import blocks, tails

# Ship task code with the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(tails)
cloudpickle.register_pickle_by_value(blocks)
