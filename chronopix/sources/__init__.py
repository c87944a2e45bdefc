"""chronopix.sources."""
