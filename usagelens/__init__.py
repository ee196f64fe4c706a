"""Usage analytics for API request logs and billing exports, on PySpark."""

from usagelens.plans.analyze import VERSION as __version__
from usagelens.plans.analyze import analyze
from usagelens.plans.report import compute_report
from usagelens.sources.readers import read_usage, supported_formats


__all__ = ["analyze", "compute_report", "read_usage", "supported_formats"]
