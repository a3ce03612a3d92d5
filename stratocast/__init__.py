"""Hierarchical forecasting over large panels of time series, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from stratocast.spec import PanelSpec

# Kernels travel to the executors inside the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PanelSpec"]
