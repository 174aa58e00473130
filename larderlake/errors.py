"""What can go wrong, by name."""


class StoreError(Exception):
    """Base of all errors here. retryable: whether the same call may succeed later."""

    retryable = False


class InvalidQuery(StoreError):
    """A statement outside the PartiQL dialect."""


class InvalidExpression(StoreError):
    """A condition or update expression that can't be parsed or evaluated."""


class InvalidArgument(StoreError):
    """A parameter out of range."""


class ConditionalCheckFailed(StoreError):
    """A condition on a write was false."""


class TransactionCanceled(StoreError):
    """A transaction had a false condition; nothing was written."""


class ValidationFailed(StoreError):
    """An item breaks its attribute schema."""


class ConflictingCommit(StoreError):
    """Another writer committed between read and commit."""

    retryable = True


class NotFound(StoreError):
    """No table, index or snapshot of that name."""
