"""Input tables derived from the given data, and the query catalogue."""
