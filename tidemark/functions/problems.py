"""Failure taxonomy: problem types, the stored kind of each, database states, terminal failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every problem type, in order of declaration.
PROBLEMS = (
    "missing-handler", "invalid-payload", "infrastructure", "handler", "handler-panicked", "application-panicked", "configuration", "schema", "message-routing",
    "cache-invariant", "idempotency", "topic", "unsafe-replay", "publish", "breaker-tripped", "constraint", "contention", "statement",
)
#: Problem types that are stored as a kind of their own; all others are Infrastructure.
KINDS = {"missing-handler": "MissingHandler", "invalid-payload": "InvalidPayload", "handler": "Handler", "handler-panicked": "Handler"}
#: Failures that no retry can mend.
TERMINAL = ("CacheOriginMismatch", "MissingEntityKey", "InvalidEntityKey")


def uri(problem: Column, space: str = "urn:tidemark:problem:") -> Column:
    return F.concat(F.lit(space), problem)


def kind(problem: Column, space: str = "urn:tidemark:problem:") -> Column:
    """Stored kind of a problem URI: MissingHandler, InvalidPayload, Handler or Infrastructure."""
    table = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (space + k, v)])
    return F.coalesce(F.try_element_at(table, problem), F.lit("Infrastructure"))


def sqlstate(code: Column) -> Column:
    """Problem of a database state by its class."""
    return F.when(F.substring(code, 1, 2) == "23", "constraint").when(F.substring(code, 1, 2) == "40", "contention").when(F.substring(code, 1, 2).isin("22", "42"), "statement").otherwise("infrastructure")


def terminal(error: Column) -> Column:
    return F.coalesce(error.isin(*TERMINAL), F.lit(False))
