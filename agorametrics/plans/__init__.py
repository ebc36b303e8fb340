"""Plan helpers: written intermediate tables, hot keys, positions."""
