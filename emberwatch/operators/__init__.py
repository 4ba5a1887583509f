"""Predicates, detectors, correlation, lookups and reports over event tables."""
