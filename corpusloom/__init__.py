"""corpusloom: text corpora to training-ready token streams, as Spark plans."""

__version__ = "3.0.0"
