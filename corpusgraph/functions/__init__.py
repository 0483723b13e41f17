"""Operators of the anchored graph engine; see the README for the map."""
