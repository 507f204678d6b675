"""Failures a caller can tell apart. Row-level problems (verification) are columns instead."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class InvalidPath(EngineError):
    pass


class EmptyArchive(EngineError):
    pass


class EntryNotFound(EngineError):
    pass


class CompressionFailed(EngineError):
    pass


class ZipStructure(EngineError):
    pass


class VerificationFailed(EngineError):
    def __init__(self, message: str, entry: str | None = None):
        super().__init__(message if entry is None else f"{entry}: {message}")
        self.entry = entry


class UnsupportedInput(EngineError):
    pass


class ArchiveConsistency(EngineError):
    pass


class RepeatedName(EngineError):
    pass


class SharedFolderMissing(EngineError):
    pass


#: Errors after which an entry is tried again with a plainer method.
RETRYABLE = (CompressionFailed, ArithmeticError, ValueError)
