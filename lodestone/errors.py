"""Errors that callers can tell apart."""


class EngineError(Exception):
    """Base of this package's errors."""


class ConfigurationError(EngineError):
    """Settings that cannot work, or that differ from the index's."""


class ParseError(EngineError):
    """A source document that cannot be read."""


class StorageError(EngineError):
    """An index that is missing, incomplete or of the wrong kind."""


class ScopeError(EngineError):
    """A document scope that is unknown, ambiguous or incomplete."""
