"""Training-data operators: ten corpus-scale building blocks and their queries.

Nothing outside this package imports it.
"""
