"""DataFrame -> DataFrame operators (groups C-H)."""
