"""Connected components over an edge table; they are with the pixel operators, which need no sub-package."""

from chronopix.operators.components import connected_components, join_spread  # noqa: F401
