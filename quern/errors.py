"""Errors that requests raise before anything runs."""

from __future__ import annotations


class QueryError(ValueError):
    """A request that isn't valid; name and status follow the usual HTTP meaning."""

    def __init__(self, message: str, name: str = "query_parse_error", status: int = 400):
        super().__init__(message)
        self.name, self.status = name, status


class NotFound(QueryError):
    def __init__(self, message: str = "missing"):
        super().__init__(message, "not_found", 404)
