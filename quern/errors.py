"""Errors, raised on the driver when a query or a change is put together."""


class QuernError(Exception):
    """Base of all errors of the library."""


class SchemaValidationError(QuernError):
    """A schema is empty, nested wrongly, or asked for a path that it lacks."""


class DocumentValidationError(QuernError):
    def __init__(self, message: str, field: str | None = None):
        super().__init__(message)
        self.field = field


class DocumentNotFoundError(QuernError):
    def __init__(self, id: str):
        super().__init__(f"no document with id {id!r}")
        self.id = id


class SerializationError(QuernError):
    """A snapshot is malformed or of an unknown version."""


class StorageError(QuernError):
    def __init__(self, message: str, cause: BaseException | None = None):
        super().__init__(message)
        self.cause = cause


class QueryError(QuernError):
    """A search names a property or an operation that doesn't fit the schema."""
