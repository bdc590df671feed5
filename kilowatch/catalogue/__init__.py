"""The registered queries: readings and raw messages derived from the given tables, and what is asked of them."""
