"""Event-log operators.  Unless said otherwise a function takes a batch or a stream."""
