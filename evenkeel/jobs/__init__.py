"""Query registry and publishing jobs."""
