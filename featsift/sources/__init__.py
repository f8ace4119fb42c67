"""Sources (driver tables, metadata CSV, array archives) and sinks."""
