"""General DataFrame operators: reshape, index, window and summary steps."""
