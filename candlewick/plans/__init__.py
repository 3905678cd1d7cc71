"""Plan-level building blocks: skew-safe series windows, size-checked joins, the bar store."""
