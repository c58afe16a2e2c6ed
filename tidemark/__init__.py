"""tidemark: a conversational BI engine and data toolkit written as Spark jobs."""

__version__ = "0.1.0"
