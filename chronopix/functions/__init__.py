"""chronopix.functions."""
