"""Panels kept up to date by a stream."""
