"""Panel scoring on Spark: clean, derive, normalise, score, rank, replay, stress and explain."""

__version__ = "0.1.0"
