"""The few Python helpers that run on executors travel inside the job, so that executors need no
installed copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
