"""Run configurations, methods and the query catalogue."""
