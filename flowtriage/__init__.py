"""Failure triage, sample-sheet validation and launch readiness as Spark jobs."""
