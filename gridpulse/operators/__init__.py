"""DataFrame operators: alignment, gap filling, readings, metrics, relational helpers, models."""
