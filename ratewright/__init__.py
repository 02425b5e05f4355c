"""Exposure-normalised rates on Spark: profile, audit, stage, rank, challenge, publish."""
