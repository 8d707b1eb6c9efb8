"""Whole analyses: from patches and a workspace to an impact graph."""
