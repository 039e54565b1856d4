"""Corpus and rollout analytics expressed as Spark DataFrames."""
