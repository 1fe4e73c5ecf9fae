"""Errors raised on the driver; executors report with status columns or raise_error."""


class EvidenceError(Exception):
    """Base of all errors of this engine."""


class EncodingFault(EvidenceError):
    """Bytes or parameters that cannot be encoded or decoded."""


class InvalidInput(EvidenceError):
    """Parameters out of range."""


class MissingPart(EvidenceError):
    """A row refers to another that isn't there."""


class Unsupported(EvidenceError):
    """An algorithm for which this environment has no implementation."""


class CryptoFault(EvidenceError):
    """A key that doesn't fit, or data that fails authentication."""
