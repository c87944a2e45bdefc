"""chronopix.plans."""
