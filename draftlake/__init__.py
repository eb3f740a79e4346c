"""Drawing-document analytics expressed as Spark DataFrame operators."""

from draftlake.session import settle, tune

__all__ = ["settle", "tune"]
