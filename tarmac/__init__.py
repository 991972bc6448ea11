"""tarmac: delay analytics on event and fact tables, written for Spark."""

__version__ = "0.1.0"
