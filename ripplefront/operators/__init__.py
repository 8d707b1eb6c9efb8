"""DataFrame operators over the fact tables."""
