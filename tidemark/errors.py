"""What the engine raises."""


class EngineError(Exception):
    """A statement that can't be carried out."""


class NotSupported(EngineError):
    """A view definition that can't be maintained."""


class LockNotAvailable(EngineError):
    """Another transaction holds the view."""


class SerializationFailure(EngineError):
    """The view changed after this transaction began."""
