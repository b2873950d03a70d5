"""Outcomes of evaluating a path over data. Each has a status word, which row-wise evaluation reports in a column."""


class PathError(Exception):
    status = "error"


class NoItemError(PathError, IndexError, AttributeError):
    status = "no_item"


class DataError(PathError):
    status = "data_error"


class OutOfBoundsError(PathError):
    status = "out_of_bounds"


class NoDataError(PathError):
    """The expression names a type, not data."""

    status = "no_data"


class ExprError(PathError, ValueError):
    """The schema or expression is wrong whatever the data is."""

    status = "invalid"


class NotContainerError(PathError, TypeError):
    status = "not_container"


class Unsupported(PathError, NotImplementedError):
    status = "not_implemented"


class SpecError(OSError, ExprError):
    """A schema text that can't be loaded."""

    def __init__(self, *args):
        Exception.__init__(self, *args)
