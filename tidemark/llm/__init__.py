"""Operators that prepare corpora for language-model training; nothing else imports this package."""
