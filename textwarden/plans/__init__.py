"""End-to-end plans and the query catalogue of the engine."""
