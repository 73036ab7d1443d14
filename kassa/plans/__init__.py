"""Composed plans: stage builders, the pipeline run, the query catalog and
its oracle SQL."""
