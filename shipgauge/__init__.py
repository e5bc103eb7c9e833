"""shipgauge: project-delivery analytics as PySpark DataFrame operators."""

from shipgauge.settings import Settings

__all__ = ["Settings"]
