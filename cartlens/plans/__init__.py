"""Training runs, snapshot tables and the query registry."""
