"""driftloom: Spark-native analytics for evolving networks and irregular event logs."""

__version__ = "0.1.0"
