"""Jobs composed from operators, and the registered table queries."""
