"""Sensitive-data detection, aliasing, egress policy and audit as Spark DataFrame jobs."""

from hushspan.session import get_spark

__all__ = ["get_spark"]
