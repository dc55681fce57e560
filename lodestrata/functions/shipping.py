"""Worker functions travel by value.

Executors need not have this library on their path: modules that define
functions for Python workers call ``ship(__name__)``.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value


def ship(module: str) -> None:
    register_pickle_by_value(sys.modules[module])
