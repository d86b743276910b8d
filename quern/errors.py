"""What can be wrong with a request. Everything raised for a bad request is a SelectorError."""

from __future__ import annotations


class SelectorError(Exception):
    """Any error of this library."""


class QueryError(SelectorError):
    """The request can't be answered. context: the option or field concerned; expression: its text."""

    def __init__(self, message: str, context: str | None = None, expression: str | None = None) -> None:
        super().__init__(message)
        self.message, self.context, self.expression = message, context, expression


class InvalidValueError(QueryError):
    """A value that can't be read, or is out of bounds."""


class TypeMismatchError(QueryError):
    """Operands that don't go together."""


class UnsupportedFunctionError(QueryError):
    """A function or aggregate method that isn't known."""


class FieldNotFoundError(QueryError):
    """A field that doesn't exist or may not be used here."""


class InvalidFieldError(QueryError):
    """A name that can't be a field here: private, or no relation."""


class ODataException(QueryError):
    """An error in the text of an expression."""


class ODataSyntaxError(ODataException):
    """Text that doesn't follow the grammar."""


class TokenizingException(ODataSyntaxError):
    """Characters that begin no token."""


class ParsingException(ODataSyntaxError):
    """A token where it can't stand."""


class UnknownFunctionException(ODataException):
    """A call of a function that the language doesn't have."""


class ArgumentCountException(ODataException):
    """A call with too few or too many arguments."""


class ArgumentTypeException(ODataException):
    """A call with an argument of the wrong kind."""
