"""Errors, and which of them a caller may try again."""

from __future__ import annotations


class QuarryError(Exception):
    recoverable = False


class SchemaNotFound(QuarryError):
    """No schema of that name is registered."""


class ValidationFailed(QuarryError):
    """Rows or a schema break the declared rules; holds all messages."""

    def __init__(self, messages: list[str]):
        super().__init__("; ".join(messages))
        self.messages = messages


class QueryError(QuarryError):
    """A query text or plan that can't be run."""


class ExportError(QuarryError):
    """Nothing to export, or a sink that can't take it."""


class ReplicationError(QuarryError):
    recoverable = True
