"""Training-data operators: ten corpus-preparation operators and their queries.

Nothing outside this sub-package imports it.
"""
