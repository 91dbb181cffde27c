"""Operators for preparing training data; each module states its method, its limits and its edge cases."""
