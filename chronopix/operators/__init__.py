"""chronopix.operators."""
