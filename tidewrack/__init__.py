"""Exposure triage of file corpora, as DataFrame transformations."""
