"""Errors: one base, and kinds that are also the built-in ones a caller would expect."""


class RatewrightError(Exception):
    """Base of all errors of this package."""


class InputValueError(RatewrightError, ValueError):
    """A value outside what an operator accepts."""


class InputTypeError(RatewrightError, TypeError):
    """A column of a type that an operator does not accept."""


class ExactnessError(RatewrightError):
    """Tables that do not reproduce the model they were made from."""
