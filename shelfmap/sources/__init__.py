"""Sources, extractors and sinks (group A)."""
