"""driftwatch: per-person trend monitoring as PySpark DataFrame and streaming jobs."""

from driftwatch.config import FEATURES, Settings
from driftwatch.session import build_session

__all__ = ["FEATURES", "Settings", "build_session"]
