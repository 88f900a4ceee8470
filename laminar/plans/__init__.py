"""Stage pipeline, configuration and the query catalogue."""
