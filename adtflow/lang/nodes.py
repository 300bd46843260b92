"""The syntax tree that text and the fluent builder share."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Place = tuple[int, int] | None


@dataclass
class Node:
    place: Place = field(default=None, kw_only=True, compare=False, repr=False)


# expressions
@dataclass
class Path(Node):
    parts: tuple[str, ...]


@dataclass
class Literal(Node):
    """kind: int, float, text, bool, uuid, bytes, decimal, date, timestamp, duration."""

    kind: str
    value: Any


@dataclass
class Param(Node):
    name: str


@dataclass
class Call(Node):
    name: str
    args: list[Node]


@dataclass
class Unary(Node):
    op: str
    of: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Membership(Node):
    item: Node
    of: Node
    negated: bool


@dataclass
class Quantifier(Node):
    """any or all elements of a list."""

    every: bool
    of: Node
    name: str
    body: Node


@dataclass
class ListValue(Node):
    items: list[Node]


@dataclass
class TupleValue(Node):
    items: list[Node]


@dataclass
class MapValue(Node):
    entries: list[tuple[str, Node]]


@dataclass
class RecordValue(Node):
    fields: list[tuple[str, Node]]


@dataclass
class Constructor(Node):
    """payload: None, a RecordValue or a TupleValue. None and Some are constructors of options."""

    type_name: str | None
    variant: str
    payload: RecordValue | TupleValue | None


@dataclass
class Match(Node):
    source: Path
    arms: list[tuple[Pattern, Node]]


# patterns
@dataclass
class Pattern(Node):
    pass


@dataclass
class Wildcard(Pattern):
    pass


@dataclass
class Binding(Pattern):
    name: str


@dataclass
class RecordPattern(Pattern):
    fields: list[tuple[str, Pattern]]
    rest: bool


@dataclass
class TuplePattern(Pattern):
    items: list[Pattern]


@dataclass
class ConstructorPattern(Pattern):
    type_name: str | None
    variant: str
    payload: RecordPattern | TuplePattern | None


# stages
@dataclass
class Let(Node):
    name: str
    params: list[tuple[str, Any]] | None
    type: Any
    body: Node


@dataclass
class Filter(Node):
    condition: Node


@dataclass
class Exists(Node):
    pipeline: Pipeline
    negated: bool


@dataclass
class Derive(Node):
    fields: list[tuple[str, Node]]


@dataclass
class Lookup(Node):
    name: str
    table: str
    target: Path
    source: Path
    limit: int


@dataclass
class Aggregate(Node):
    """fields: output, function, argument, and precision, scale and mode of decimal_avg."""

    keys: list[Path] | None
    fields: list[tuple[str, str, Node | None, tuple]]


@dataclass
class Window(Node):
    partition: list[Path]
    sort: list[tuple[Path, bool]]
    fields: list[tuple[str, str]]


@dataclass
class SetOperation(Node):
    kind: str
    pipeline: Pipeline


@dataclass
class Select(Node):
    """fields: a path, or a name with an expression."""

    fields: list[Path | tuple[str, Node]]


@dataclass
class Sort(Node):
    keys: list[tuple[Path, bool]]


@dataclass
class Take(Node):
    """Rows after the first offset, at most count."""

    offset: int
    count: int


@dataclass
class Page(Node):
    size: int
    direction: str | None = None
    cursor: str | None = None


@dataclass
class Pipeline(Node):
    source: str
    stages: list[Node]


@dataclass
class Explain(Node):
    pipeline: Node
    analyze: bool


# declarations and changes
@dataclass
class TypeDecl(Node):
    name: str
    type: Any


@dataclass
class TableDecl(Node):
    name: str
    row: str
    key: str | None
    generated: dict[str, str]


@dataclass
class IndexDecl(Node):
    table: str
    components: list[tuple[Path, bool]]
    unique: bool
    predicate: Node | None


@dataclass
class ReferenceDecl(Node):
    source: str
    source_fields: list[Path]
    target: str
    target_fields: list[Path]


@dataclass
class DropReference(Node):
    reference: ReferenceDecl


@dataclass
class SequenceDecl(Node):
    name: str
    start: int


@dataclass
class Insert(Node):
    table: str
    rows: list[Node] | Param
    upsert: bool
    many: bool
    returning: list[Path] | None


@dataclass
class Update(Node):
    table: str
    target: list[Node]
    sets: list[tuple[Path, Node]]
    returning: list[Path] | None


@dataclass
class Delete(Node):
    table: str
    target: list[Node]
    returning: list[Path] | None


@dataclass
class Expect(Node):
    op: str
    count: int


@dataclass
class Migration(Node):
    """steps: an operation's name and its arguments."""

    name: str
    parent: str | None
    steps: list[tuple[str, tuple]]
