"""Host-security log analytics as DataFrame-to-DataFrame functions on Spark."""

from hostguard.config import DetectionConfig
from hostguard.operators.skew import SkewPolicy

__all__ = ["DetectionConfig", "SkewPolicy"]
