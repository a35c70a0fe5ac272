"""Operators for preparing training text at scale; nothing else in lattica imports them."""
