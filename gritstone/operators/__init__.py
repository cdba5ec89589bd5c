"""Filters, reads, trace order, detectors, correlation and incidents, as functions from DataFrame to DataFrame. `now` is always an argument."""
