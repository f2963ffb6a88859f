"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from ..shipping import ship_by_value

ship_by_value(__name__)
