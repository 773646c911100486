"""Typed entities: what the payload of a message type must be, and payloads checked against it and written from it.

A payload conforms when it is one JSON value whose fields have the declared types: objects by name, with any other fields let go, or
arrays by position with exactly as many members. Numbers aren't read from text, integers aren't read from fractions, null is only for optional
fields, a name that comes twice is refused. An open enumeration is a text: values that aren't known pass and keep their spelling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .identity import idempotency_key

_UUID = r"\A(?:urn:uuid:)?(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9a-fA-F]{32}|\{[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\})\z"


def uuid(text: Column) -> Column:
    """A UUID in any of its written forms as lower-case text with hyphens; null for anything else."""
    digits = F.lower(F.regexp_replace(F.regexp_replace(text, "^urn:uuid:", ""), "[{}-]", ""))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(text.rlike(_UUID), F.concat_ws("-", *parts))


def json_value(text: Column) -> Column:
    """The text as a variant where it is one whole JSON value, else null. The parser stops after a first value, so the text is tried inside an array and inside an object: no text ends both early."""
    listed = F.call_function("try_variant_get", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.lit("$"), F.lit("array<variant>"))
    held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & held.isNotNull(), F.try_parse_json(text))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.call_function("try_variant_get", v, F.lit(path), F.lit(kind))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once and standing once in the expression, however often `then` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _said(ok: Column, value: Column) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), value.alias("value"))


class Kind:
    """What a value must be: `judge` makes struct<ok, value> of a variant (null: not there), the value of type `sql`."""

    def __init__(self, names: tuple[str, ...], sql: str, read: Callable[[Column], Column] | None = None):
        self.names, self.sql, self.read = names, sql, read or (lambda x: x)

    def judge(self, v: Column) -> Column:
        def said(v: Column) -> Column:
            named = F.regexp_replace(F.schema_of_variant(v), r"\(.*\)", "").isin(*self.names)
            return let(self.read(_get(v, "$", self.sql)), lambda x: _said(named & x.isNotNull(), x))

        return let(v, said)


class Optional(Kind):
    """Not there and null are null."""

    def __init__(self, of: Kind):
        self.of, self.sql = of, of.sql

    def judge(self, v: Column) -> Column:
        none = _said(F.lit(True), F.lit(None).cast(self.sql))
        return let(v, lambda v: F.when(v.isNull() | F.is_variant_null(v), none).otherwise(self.of.judge(v)))


class List(Kind):
    def __init__(self, of: Kind):
        self.of, self.sql = of, f"array<{of.sql}>"

    def judge(self, v: Column) -> Column:
        every = F.transform(_get(v, "$", "array<variant>"), self.of.judge)
        return let(every, lambda e: _said(F.forall(e, lambda x: x["ok"]), F.transform(e, lambda x: x["value"])))


class Struct(Kind):
    """fields: (name, kind), in order."""

    def __init__(self, *fields: tuple[str, Kind]):
        self.fields = fields
        self.sql = "struct<" + ",".join(f"`{n}`:{k.sql}" for n, k in fields) + ">"

    def judge(self, v: Column) -> Column:
        named = lambda v, n: _get(v, "$['" + n.replace("'", "\\'") + "']", "variant")

        def members(v: Column, listed: Column) -> Column:
            shape = F.schema_of_variant(v).startswith("OBJECT") | (F.size(listed) == len(self.fields))
            each = [k.judge(F.when(listed.isNotNull(), F.get(listed, F.lit(i))).otherwise(named(v, n))).alias(n) for i, (n, k) in enumerate(self.fields)]
            return F.struct(F.coalesce(shape, F.lit(False)).alias("shape"), F.struct(*each).alias("m"))

        def said(got: Column) -> Column:
            ok = got["shape"]
            for n, _ in self.fields:
                ok = ok & got["m"][n]["ok"]
            return _said(ok, F.struct(*[got["m"][n]["value"].alias(n) for n, _ in self.fields]))

        return let(let(v, lambda v: let(_get(v, "$", "array<variant>"), lambda listed: members(v, listed))), said)


TEXT = Kind(("STRING",), "string")
UUID = Kind(("STRING",), "string", uuid)
LONG = Kind(("BIGINT",), "bigint")
INT = Kind(("BIGINT",), "int")
DOUBLE = Kind(("BIGINT", "DECIMAL", "DOUBLE"), "double", lambda x: F.when(~x.isin(float("inf"), float("-inf")), x))
BOOL = Kind(("BOOLEAN",), "boolean")


class Open(Kind):
    """An open enumeration: any text, of which some are known."""

    def __init__(self, *known: str):
        super().__init__(("STRING",), "string")
        self.known = known

    def recognized(self, value: Column) -> Column:
        return F.coalesce(value.isin(*self.known), F.lit(False))


@dataclass(frozen=True)
class Entity:
    """A message type: its topic, its payload, and the field that names the entity (and the partition, unless another one does)."""

    message_type: str
    topic: str
    payload: Struct
    key: str
    partition: str | None = None

    def __post_init__(self) -> None:
        names = [n for n, _ in self.payload.fields]
        if len(set(names)) != len(names) or self.key not in names or (self.partition or self.key) not in names:
            raise ValueError(f"{self.message_type}: fields must differ and hold the key")

    def judge(self, raw: Column) -> Column:
        """struct<ok, value>: whether a text is a payload of this type (false for null), and the payload as a struct."""
        return self.payload.judge(json_value(raw))

    def conforms(self, raw: Column) -> Column:
        return self.judge(raw)["ok"]

    def read(self, raw: Column) -> Column:
        """The payload as a struct, null where it doesn't conform."""
        return let(self.judge(raw), lambda j: F.when(j["ok"], j["value"]))

    def write(self, value: Column) -> Column:
        """A struct as the text that is stored and sent: the declared fields in their order, null ones too."""
        return F.to_json(value, {"ignoreNullFields": "false"})

    def known(self, value: Column, field: str) -> Column:
        """Whether an open field of a struct has a value that is known."""
        return dict(self.payload.fields)[field].recognized(value[field])

    def messages(self, rows: DataFrame, namespace: str | None = None, version: str | None = None) -> DataFrame:
        """Rows of typed columns (the fields; any others stay) as messages: message_type, topic, payload, entity_key, partition_key and, with
        a column of versions, the idempotency key of (entity, version)."""
        name = lambda f: F.col(f).cast("string")
        value = F.struct(*[F.col(n).cast(k.sql).alias(n) for n, k in self.payload.fields])
        out = rows.withColumns({"message_type": F.lit(self.message_type), "topic": F.lit(self.topic), "payload": self.write(value), "entity_key": name(self.key), "partition_key": name(self.partition or self.key)})
        if version is None:
            return out
        canonical = F.concat(F.lit('["'), name(self.key), F.lit('",'), name(version), F.lit("]"))
        return out.withColumn("idempotency_key", idempotency_key(namespace or f"tidemark:{self.topic}", canonical))


@dataclass
class Registry:
    """The entities that a service knows; a message type and a topic belong to one entity each."""

    entities: dict[str, Entity] = field(default_factory=dict)

    def add(self, entity: Entity) -> Registry:
        if entity.message_type in self.entities or any(e.topic == entity.topic for e in self.entities.values()):
            raise ValueError(f"{entity.message_type} or topic {entity.topic} is registered already")
        self.entities[entity.message_type] = entity
        return self

    def of_topic(self, topic: str) -> Entity:
        for e in self.entities.values():
            if e.topic == topic:
                return e
        raise LookupError(f"no entity on topic {topic}")

    def types(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t,) for t in sorted(self.entities)], "message_type string")

    def conforms(self, message_type: Column, raw: Column) -> Column:
        """Whether a payload is what its message type says; false for types that aren't registered."""
        out = F.lit(False)
        for t, e in sorted(self.entities.items()):
            out = F.when(message_type == t, e.conforms(raw)).otherwise(out)
        return out


# The two contracts of the example services, their fields and statuses.
PRODUCT = Entity("product_snapshot", "products", Struct(("product_id", UUID), ("name", TEXT), ("price_cents", LONG), ("status", Open("Draft", "Available", "Discontinued")), ("available", LONG)), "product_id")
ORDER = Entity("order_snapshot", "orders", Struct(("order_id", UUID), ("product_id", UUID), ("quantity", LONG), ("status", Open("Placed", "Fulfilled", "Cancelled"))), "order_id")


def contracts() -> Registry:
    return Registry().add(PRODUCT).add(ORDER)
