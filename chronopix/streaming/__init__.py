"""chronopix.streaming."""
