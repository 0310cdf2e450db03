"""Errors of the statement layer; all else is Spark's own."""


class EngineError(Exception):
    pass


class NotFound(EngineError):
    pass


class ParseError(EngineError):
    pass


class InvalidArgument(EngineError):
    pass


class Unsupported(EngineError):
    pass
