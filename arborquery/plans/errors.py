"""What can be wrong with an expression."""


class ExpressionError(ValueError):
    """Any mistake in an expression."""


class UnknownPredicate(ExpressionError):
    """A token that names no predicate, modifier or operator."""


class MissingOperator(ExpressionError):
    """Two predicates side by side where joining them by -a has been switched off."""


class MissingPredicate(ExpressionError):
    """An operator or modifier without a predicate to work on."""


class UnbalancedParentheses(ExpressionError):
    """A parenthesis without its partner."""


class EmptyParentheses(ExpressionError):
    """Nothing between parentheses."""


class NotANumber(ExpressionError):
    """A number was asked for."""


class InvalidParameter(ExpressionError):
    """A value or option that a predicate doesn't take."""


class IncompletePredicate(ExpressionError):
    """A predicate without the value it needs."""


class UnbalancedQuotes(ExpressionError):
    """A quote or escape that does not end."""


class UnsupportedPredicate(NotImplementedError):
    """A predicate that is known by name only."""
