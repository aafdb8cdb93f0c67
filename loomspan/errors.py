"""The one kind of error that patterns, filters and grammars raise."""


class QueryError(ValueError):
    pass
