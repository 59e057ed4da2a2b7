"""Operators for the preparation of training text and code. Nothing else imports this package."""
