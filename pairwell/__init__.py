"""Cohort-study operators over Spark DataFrames."""

from pairwell.config import StudyConfig

__all__ = ["StudyConfig"]
