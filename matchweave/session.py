"""Session helpers."""

from __future__ import annotations

from pyspark import cloudpickle

import matchweave


def ship() -> None:
    """Send this package's code along with the functions that run in Python workers.

    Workers then need numpy, pandas and pyarrow, but not this package.
    """
    cloudpickle.register_pickle_by_value(matchweave)
