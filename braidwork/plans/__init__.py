"""End-to-end plans and the query registry."""
