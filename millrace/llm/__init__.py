"""Operators for large training-text collections. Nothing else imports this package."""
