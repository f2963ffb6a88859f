"""Whole plans put together from sources and operators."""
