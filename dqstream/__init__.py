"""Data-quality gate for event streams and tables, on Spark DataFrames."""

from dqstream.policy import FieldRule, Policy, PolicyError
from dqstream.session import configure

__all__ = ["FieldRule", "Policy", "PolicyError", "configure"]
