"""rotorline: quality, annotation, scoring and monitoring of rotating-machine sensor data on Spark."""

from rotorline.session import build_session, materialize

__all__ = ["build_session", "materialize"]
