"""Readers and writers by format, dataset discovery, tags and sidecar metadata."""
