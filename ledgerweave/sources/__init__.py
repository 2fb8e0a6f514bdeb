"""Sources and sinks: driver tables, derived landing books, ingest, writers."""
