"""Operators of a training-data pipeline: token files, near duplicates, HTML
extraction, quality and toxicity scores, mixing, sharding, secret scans and
benchmark decontamination.  Nothing else in the library imports this package."""
