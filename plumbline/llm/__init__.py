"""Operators of a training-data pipeline; nothing else in plumbline imports them."""
