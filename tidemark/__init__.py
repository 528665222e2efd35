"""tidemark: event-study analytics over trade and event tapes, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
