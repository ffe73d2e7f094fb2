"""Operators of a training-data pipeline; nothing else in the library imports this folder."""

from pyspark import cloudpickle

import ledgerlens

# functions travel with their tasks, so executors need not have the package installed
cloudpickle.register_pickle_by_value(ledgerlens)
