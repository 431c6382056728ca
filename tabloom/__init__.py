"""tabloom: tabular preparation and model selection as PySpark jobs."""

__version__ = "0.1.0"
