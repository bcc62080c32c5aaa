"""Whole analyses: search, fusion, explanation, baseline."""
