"""Whole plans: the engine facade and the query catalogue."""
