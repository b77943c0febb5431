"""Errors that callers can tell apart."""


class SieveError(Exception):
    """Base of this package's errors."""


class InvalidInputError(SieveError, ValueError):
    """Input that can't be read as rows of cells."""


class BatchTooLargeError(SieveError, ValueError):
    """More rows than the configured limit."""


class ScorerUnavailableError(SieveError):
    """A pair scorer gave no answer."""
