"""Readers for reports, traces, regions, dimensions and event tables."""
