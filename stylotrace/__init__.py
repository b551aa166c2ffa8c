"""Text forensics on Spark: corpora, features, statistics, detectors and experiments as DataFrame jobs."""
