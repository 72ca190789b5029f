"""Operators of a training-data pipeline: rules, de-duplication, scans, mixing, packing and formats.

Nothing else in the library imports this package.
"""

from __future__ import annotations

from pyspark import cloudpickle

import demandloom

# Python tasks get the functions themselves, so the workers need not find the package on their path.
cloudpickle.register_pickle_by_value(demandloom)
