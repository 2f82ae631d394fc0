"""Finds and ranks ambiguous passages in large normative documents, on Spark."""
