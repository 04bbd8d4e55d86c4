"""Errors that the engine raises."""


class CEPError(Exception):
    """Base of all errors of the engine."""


class DuplicatedStreamError(CEPError):
    """A stream of that id is registered already."""


class UndefinedStreamError(CEPError):
    """No stream of that id is known."""


class QuerySyntaxError(CEPError, ValueError):
    """The query text can't be parsed."""


class AnalysisError(CEPError, ValueError):
    """The query parses but refers to something unknown or ill-typed."""
