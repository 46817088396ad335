"""Operators for training data over chat logs and documents; nothing else imports this subpackage."""
