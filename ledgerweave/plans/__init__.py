"""Stage wiring (``reconcile``), the query registry and the SQL oracle."""
