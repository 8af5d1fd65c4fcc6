"""Compositions of operators: search, answers, evaluation, ingest."""
