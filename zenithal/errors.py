"""Errors by category."""

from __future__ import annotations


class EngineError(Exception):
    """Any error that the engine itself raises."""


class ParseError(EngineError):
    """The text is no statement of the dialect."""


class UnsupportedQueryError(EngineError):
    """The statement is well formed, but the dialect leaves it out."""


class AnalysisError(EngineError):
    """Names, arguments or joins of the statement do not fit the catalog."""


class ResultTooLargeError(EngineError):
    """The result is larger than the session's limit."""
