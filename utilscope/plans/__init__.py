"""End-to-end plans: fact building, the shared market tables and the query catalog."""
