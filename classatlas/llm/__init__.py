"""Operators that prepare training text, each over whole tables; nothing else in the package imports them."""
