"""Automatic profiling of tables of any size with Spark."""

from tablescope.operators.clean import clean_table
from tablescope.profile import Profile, load_analyse_clean, profile_table
from tablescope.session import build_session

__all__ = ["Profile", "build_session", "clean_table", "load_analyse_clean", "profile_table"]
