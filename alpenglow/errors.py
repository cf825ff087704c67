"""Errors of the engine."""


class LandscapeError(Exception):
    """Base of all errors raised here on purpose."""


class NotBuiltError(LandscapeError, RuntimeError):
    """A landscape is asked for something before it is built."""


class ParameterError(LandscapeError, ValueError):
    """An argument is outside its range."""


class DataError(LandscapeError, ValueError):
    """The input table can't be turned into a landscape."""
