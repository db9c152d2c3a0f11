"""Spark jobs that turn clinical-trial eligibility text into validated, structured criteria."""
