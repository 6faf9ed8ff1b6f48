"""Compositions: whole preparation, sampling, recommendation and report jobs."""
