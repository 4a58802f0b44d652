"""Spark-native analytics for event-on-trajectory recordings."""

from spikegrid.settings import Settings
from spikegrid.session import build_session, tune

__all__ = ["Settings", "build_session", "tune"]
