"""Partitioned tables that a run writes and later runs read."""
