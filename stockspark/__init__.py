"""stockspark: retail inventory analytics as Spark DataFrame jobs."""

from stockspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
