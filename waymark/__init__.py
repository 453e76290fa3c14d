"""Waymark: DataFrame operators that reconcile planned work with observed sensor evidence."""
