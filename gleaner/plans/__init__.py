"""Whole jobs: reports over runs and pages, evaluation and extraction pipelines."""
