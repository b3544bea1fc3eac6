"""Operators of a training-data pipeline over the ``documents``, ``pages``,
``benchmark`` and ``conversations`` tables.  Nothing else in the library
imports this package.

Functions and classes of this package travel to the executors by value, so
the workers need not have the package installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
