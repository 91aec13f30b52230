"""Operators over op logs, indexes, manifests, rosters and cursors."""
