"""tessera: a DataFrame analytics library and query catalog on plain PySpark."""

from tessera.session import profile, session

__all__ = ["profile", "session"]
