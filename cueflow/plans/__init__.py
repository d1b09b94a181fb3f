"""End-to-end jobs and the registry of runnable queries."""
