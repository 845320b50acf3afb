"""Errors of jobs, sources and sinks."""


class RowforgeError(Exception):
    """Any error of this library."""


class InvalidArguments(RowforgeError):
    """Options that do not go together, or that cannot be read."""


class InvalidRegex(InvalidArguments):
    """A pattern outside the supported dialect."""


class OpenInput(RowforgeError):
    """An input that is not there."""


class CreateOutput(RowforgeError):
    """An output that cannot be created."""


class OutputIsInput(RowforgeError):
    """An output that is one of the inputs."""


class ReplaceInput(RowforgeError):
    """A file edited in place that cannot be replaced."""


class Backup(RowforgeError):
    """A backup that cannot be made."""


class Processing(RowforgeError):
    """A failure while rows are worked on, such as a line that is not UTF-8."""
