"""Relational operators over marks, boxes, pairs and clusters."""
