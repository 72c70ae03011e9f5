"""Data governance jobs on Spark: classify, mask, decide, audit, append, triage."""
