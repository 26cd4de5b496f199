"""codequarry: build and score code question-answering data sets on Spark."""

__version__ = "0.1.0"
