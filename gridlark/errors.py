"""The failures that readers report."""


class SourceError(Exception):
    code = "read-failed"


class FileMissing(SourceError):
    code = "file-not-found"


class UnsupportedScheme(SourceError):
    code = "unsupported-scheme"


class UnsupportedFormat(SourceError):
    code = "unsupported-format"


class UnknownColumn(SourceError):
    """A column that is not there; `suggestions` has the nearest names."""

    code = "unknown-column"

    def __init__(self, name: str, suggestions: list[str]):
        hint = f"; did you mean {', '.join(suggestions)}?" if suggestions else ""
        super().__init__(f"unknown column {name!r}{hint}")
        self.name, self.suggestions = name, suggestions


class TooManyValues(ValueError):
    """A verb makes a column or a frame of each value, and there are more values than it can."""
