"""Operators for preparing training data; nothing else in the library imports this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions travel with the task, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
