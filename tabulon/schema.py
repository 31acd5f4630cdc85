"""Object types: fixed lists of typed properties, and how they map to Spark types.

Property 0 is the primary key. Integers are unsigned: BIGINT holds 63 bits, `wide` properties hold all 64 as DECIMAL(20,0). Only links
can be null; blobs and collections are empty instead.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import NoSuchType, SchemaMismatch

MOST_PROPS = MOST_TYPES = 256


class Kind(str, Enum):
    INT = "int"
    BLOB = "blob"
    LIST = "list"
    SET = "set"
    LINK = "link"
    LINK_SET = "link_set"
    DICT = "dict"


class Elem(str, Enum):
    INT = "int"
    BLOB = "blob"


class Rule(str, Enum):
    """What deleting a link's target does: clear the link, or refuse. CASCADE: deleting the source deletes the target."""

    NULLIFY = "nullify"
    CASCADE = "cascade"
    BLOCK = "block"


LINKS = (Kind.LINK, Kind.LINK_SET)


@dataclass(frozen=True)
class Prop:
    name: str
    kind: Kind = Kind.INT
    elem: Elem = Elem.INT
    target: int = 0
    rule: Rule = Rule.NULLIFY
    indexed: bool = False
    wide: bool = False

    def spark_type(self) -> T.DataType:
        number = T.DecimalType(20, 0) if self.wide else T.LongType()
        elem = T.BinaryType() if self.elem == Elem.BLOB else number
        return {
            Kind.INT: number, Kind.BLOB: T.BinaryType(), Kind.LIST: T.ArrayType(elem), Kind.SET: T.ArrayType(elem),
            Kind.LINK: T.LongType(), Kind.LINK_SET: T.ArrayType(T.LongType()), Kind.DICT: T.MapType(T.BinaryType(), T.LongType()),
        }[self.kind]

    def stored(self, value: Column) -> Column:
        """value in the form that is kept: no nulls but for links, sets without repeats in ascending order. A null integer is an error."""
        value = value.cast(self.spark_type())
        if self.kind == Kind.INT:
            return F.when(value.isNull(), F.raise_error(F.lit(f"{self.name}: an integer can't be null"))).otherwise(value)
        if self.kind == Kind.LINK:
            return value
        value = F.coalesce(value, self.empty())
        return F.array_sort(F.array_distinct(value)) if self.kind in (Kind.SET, Kind.LINK_SET) else value

    def comparable(self, value: Column) -> Column:
        """value in a form that Spark can compare and hash: dictionaries as entries by ascending key."""
        return F.array_sort(F.map_entries(value)) if self.kind == Kind.DICT else value

    def empty(self) -> Column:
        """The default: 0, null, or an empty blob or collection."""
        if self.kind == Kind.INT:
            return F.lit(0).cast(self.spark_type())
        if self.kind == Kind.LINK:
            return F.lit(None).cast("bigint")
        if self.kind == Kind.BLOB:
            return F.lit(b"")
        if self.kind == Kind.DICT:
            return F.map_from_arrays(F.array().cast("array<binary>"), F.array().cast("array<bigint>"))
        return F.array().cast(self.spark_type())


@dataclass(frozen=True)
class ObjectType:
    name: str
    props: tuple[Prop, ...] = field(default_factory=tuple)
    embedded: bool = False

    def __post_init__(self) -> None:
        names = [p.name for p in self.props]
        if not names or self.props[0].kind != Kind.INT:
            raise SchemaMismatch("property 0 must be an integer, the primary key")
        if len(names) > MOST_PROPS or len(set(names)) < len(names) or any(n.startswith("_") for n in names):
            raise SchemaMismatch("at most 256 properties, with names of their own that don't start with _")

    @property
    def pk(self) -> str:
        return self.props[0].name

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.props]

    def prop(self, key: int | str) -> Prop:
        return self.props[key] if isinstance(key, int) else next(p for p in self.props if p.name == key)

    def links_to(self, type_id: int) -> list[Prop]:
        return [p for p in self.props if p.kind in LINKS and p.target == type_id]

    def struct(self) -> T.StructType:
        """The row type: object key, version, then the properties with their definition as metadata."""
        rows = [T.StructField("_okey", T.LongType()), T.StructField("_version", T.LongType())]
        return T.StructType(rows + [T.StructField(p.name, p.spark_type(), True, {k: getattr(v, "value", v) for k, v in asdict(p).items()} | {"pos": i}) for i, p in enumerate(self.props)])

    def with_property(self, prop: Prop) -> ObjectType:
        return replace(self, props=(*self.props, prop))

    def without_property(self, at: int) -> ObjectType:
        if not 1 <= at < len(self.props):
            raise SchemaMismatch("the primary key can't be removed, nor what isn't there")
        return replace(self, props=self.props[:at] + self.props[at + 1 :])

    def to_json(self) -> dict:
        return {"name": self.name, "embedded": self.embedded, "props": [{k: getattr(v, "value", v) for k, v in asdict(p).items()} for p in self.props]}

    @staticmethod
    def from_json(d: dict) -> ObjectType:
        made = (Prop(**(p | {"kind": Kind(p["kind"]), "elem": Elem(p["elem"]), "rule": Rule(p["rule"])})) for p in d["props"])
        return ObjectType(d["name"], tuple(made), d["embedded"])


def of_kinds(name: str, kinds: list[Kind]) -> ObjectType:
    return ObjectType(name, tuple(Prop(f"p{i}", k) for i, k in enumerate(kinds)))


def of_ints(name: str, n: int) -> ObjectType:
    return of_kinds(name, [Kind.INT] * n)


def check_types(types: list[ObjectType]) -> list[ObjectType]:
    if len(types) > MOST_TYPES:
        raise SchemaMismatch("at most 256 types")
    return types


def validate(types: list[ObjectType], expected: list[list[Kind]]) -> None:
    """Type count, property counts and kinds must agree; element kinds, targets, rules and index flags aren't compared."""
    if [[p.kind for p in t.props] for t in types] != [list(e) for e in expected]:
        raise SchemaMismatch("types differ from what was expected")


def type_at(types: list[ObjectType], type_id: int) -> ObjectType:
    if not 0 <= type_id < len(types):
        raise NoSuchType(str(type_id))
    return types[type_id]
