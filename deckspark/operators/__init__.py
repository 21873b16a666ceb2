"""DataFrame -> DataFrame operators; none of them does I/O of its own."""
