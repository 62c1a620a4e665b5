"""The one exception of all readers."""


class SourceNotFoundError(FileNotFoundError):
    """A source is missing or isn't what it should be."""
