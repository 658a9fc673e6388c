"""tickwise – market-data and portfolio analytics as Spark DataFrame jobs."""
from .session import get_session, shared_dir  # noqa: F401

__all__ = ["get_session", "shared_dir"]
