"""Scans: source trees, patches, configuration, stored indexes."""
