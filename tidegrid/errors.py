"""Errors with the kind an HTTP front end would report."""


class QueryError(Exception):
    """A query that cannot be answered; kind is the category, status the HTTP code."""

    kind, status = "execution", 422


class BadData(QueryError):
    kind, status = "bad_data", 400


class LimitExceeded(QueryError):
    kind, status = "execution", 422


class Timeout(QueryError):
    kind, status = "timeout", 503


class Unavailable(QueryError):
    kind, status = "unavailable", 503
