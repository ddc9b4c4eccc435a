"""Scans and sinks: manifests, group exports, sharded tables, files, the normalised store."""
