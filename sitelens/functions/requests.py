"""Request schemas compiled to expressions: a table of fields with type, default, bounds and values; a struct of the result.

A request is a JSON object as text, or a map of query parameters, whose values are all text. A schema gives struct(ok, value,
errors): value has every field of the schema with its type, coerced or by default, and is null where there are
errors; errors are structs of path and code, in the order of the fields. Fields that the schema doesn't name are left out. What the
fields say together (rules) is asked only where each is right by itself. Everything is an expression on the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of errors.
TYPE, VALUE, SMALL, BIG, FORMAT, CUSTOM = "invalid_type", "invalid_value", "too_small", "too_big", "invalid_format", "custom"
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Addresses that parse: a scheme and, for those of the web, a host.
ADDRESS = r"(?i)^\s*((https?|wss?|ftp):[/\\]*[^\s/\\?#@:<>\[\]^|%]+(:\d{0,5})?([/\\?#].*)?|(?!(https?|wss?|ftp|file):)[a-z][a-z0-9+.-]*:.*)\s*$"
SAFE = float(2**53 - 1)


@dataclass(frozen=True)
class Field:
    """kind: string, integer, number or boolean. optional: may be absent; nullable: may be null, which counts as absent; default: what an absent one
    is; blank: an empty parameter counts as absent; coerce: text, booleans and null become numbers; least and most: of a number, or of a text's length;
    values: the only ones; address: a text that parses as one."""

    name: str
    kind: str = "string"
    optional: bool = False
    nullable: bool = False
    default: object = None
    blank: bool = False
    coerce: bool = False
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] = ()
    address: bool = False


@dataclass(frozen=True)
class Schema:
    """rules: (condition on the struct of values, path); a rule that does not hold is a `custom` error."""

    fields: tuple[Field, ...]
    rules: tuple[tuple[Callable[[Column], Column], str], ...] = ()


def _number(text: Column) -> Column:
    """A text as a number, null where it is none: blank is 0, hexadecimal is known."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    hexadecimal = F.conv(F.regexp_extract(trimmed, "^0[xX]([0-9a-fA-F]{1,13})$", 1), 16, 10).cast("double")
    return F.when(trimmed == "", 0.0).when(trimmed.rlike(DECIMAL), trimmed.try_cast("double")).when(trimmed.rlike("^0[xX][0-9a-fA-F]{1,13}$"), hexadecimal)


@dataclass(frozen=True)
class _Given:
    """A field of a request: whether it is there, its JSON type (STRING, NUMBER, BOOLEAN, NULL or OTHER), and it as text, number and truth."""

    there: Column
    kind: Column
    text: Column
    number: Column
    truth: Column


def _of_body(body: Column, name: str) -> _Given:
    at = F.try_variant_get(body, f"$.{name}", "variant")
    found = F.schema_of_variant(at)
    number = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    kind = F.when(found == "STRING", "STRING").when(number, "NUMBER").when(found == "BOOLEAN", "BOOLEAN").when(found == "VOID", "NULL").otherwise("OTHER")
    return _Given(at.isNotNull(), kind, F.try_variant_get(body, f"$.{name}", "string"), F.try_variant_get(body, f"$.{name}", "double"), F.try_variant_get(body, f"$.{name}", "boolean"))


def _of_parameters(parameters: Column, name: str) -> _Given:
    text = F.try_element_at(parameters, F.lit(name))
    none = F.lit(None)
    return _Given(text.isNotNull(), F.lit("STRING"), text, none.cast("double"), none.cast("boolean"))


def _field(f: Field, given: _Given) -> tuple[Column, Column]:
    """(value, code of its first error or null)."""
    null = F.coalesce(given.kind == "NULL", F.lit(False))
    absent = ~given.there
    if f.nullable:
        absent = absent | null
    if f.blank:
        absent = absent | F.coalesce((given.kind == "STRING") & (given.text == ""), F.lit(False))
    default = F.lit(f.default).cast(SQL_TYPES[f.kind])
    if f.kind == "string":
        value, right = F.when(given.kind == "STRING", given.text), given.kind == "STRING"
        size = F.length(value)
    elif f.kind == "boolean":
        value, right, size = F.when(given.kind == "BOOLEAN", given.truth), given.kind == "BOOLEAN", None
    else:
        value = F.when(given.kind == "NUMBER", given.number)
        if f.coerce:
            value = F.when(given.kind == "STRING", _number(given.text)).when(given.kind == "BOOLEAN", given.truth.cast("int").cast("double")).when(null, 0.0).otherwise(value)
        right = value.isNotNull()
        if f.kind == "integer":
            right = right & (value == F.floor(value)) & (F.abs(value) <= SAFE)
        size = value
    right = F.coalesce(right, F.lit(False))
    code = F.when(~right, TYPE)
    if f.values:
        code = F.when(~F.coalesce(right & value.isin(*f.values), F.lit(False)), VALUE)
    if f.address:
        code = code.when(~value.rlike(ADDRESS), FORMAT)
    if f.least is not None:
        code = code.when(size < f.least, SMALL)
    if f.most is not None:
        code = code.when(size > f.most, BIG)
    # A default stands for an absent field; an absent one without any must be optional.
    may = f.optional or f.nullable or f.default is not None
    code = F.when(absent, F.lit(None) if may else F.lit(VALUE if f.values else TYPE)).otherwise(code)
    return F.when(absent, default).otherwise(value.cast(SQL_TYPES[f.kind])), code


def _checked(schema: Schema, given: Callable[[str], _Given], sound: Column) -> Column:
    fields = {f.name: _field(f, given(f.name)) for f in schema.fields}
    value = F.struct(*(v.alias(n) for n, (v, _) in fields.items()))
    error = lambda path, code: F.struct(F.lit(path).alias("path"), code.alias("code"))
    own = F.filter(F.array(*(error(n, code) for n, (_, code) in fields.items())), lambda e: e["code"].isNotNull())
    rules = [error(path, F.when(~F.coalesce(rule(value), F.lit(False)), CUSTOM)) for rule, path in schema.rules]
    if rules:
        own = F.when(F.size(own) == 0, F.filter(F.array(*rules), lambda e: e["code"].isNotNull())).otherwise(own)
    errors = F.when(sound, own).otherwise(F.array(error("", F.lit(TYPE))))
    ok = F.size(errors) == 0
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), errors.alias("errors"))


def body(text: Column, schema: Schema) -> Column:
    """Checks a JSON object; a text that is none, null included, has one error without a path."""
    parsed = F.try_parse_json(text)
    sound = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return _checked(schema, lambda name: _of_body(parsed, name), sound)


def parameters(given: Column, schema: Schema) -> Column:
    """Checks a map of query parameters; a null map is an empty one."""
    given = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return _checked(schema, lambda name: _of_parameters(given, name), F.lit(True))


NEW_SCAN = Schema((Field("url", address=True), Field("source", values=("search", "settings", "api"), default="search"), Field("background", "boolean", default=True)))
DOMAINS = Schema((Field("limit", "number", coerce=True, least=1, most=100, default=50), Field("cursor", optional=True)))
OFFERS = Schema((
    Field("page", "integer", coerce=True, least=1, default=1, blank=True), Field("pageSize", "integer", coerce=True, least=1, most=100, default=50, blank=True), Field("search", optional=True, blank=True),
    Field("hasPrice", values=("true", "false"), optional=True), Field("minConfidence", "integer", coerce=True, least=0, most=100, optional=True),
    Field("sortBy", values=("confidence", "amount", "title"), default="confidence", blank=True), Field("sortDir", values=("asc", "desc"), default="desc", blank=True),
))
NEW_NOTE = Schema(
    (Field("content", most=5000, optional=True), Field("type", values=("note", "review"), default="note"), Field("riskDecision", values=("risky", "not_risky"), optional=True)),
    ((lambda v: F.when(v["type"] == "note", F.length(v["content"]) > 0).otherwise(v["riskDecision"].isNotNull()), ""),),
)
NOTE_CHANGE = Schema((Field("content", least=1, most=5000),))
RISK_FLAG = Schema((Field("isRisky", "boolean"), Field("note", most=1000, optional=True)))
COMPARISON = Schema((Field("urlA", least=1), Field("urlB", least=1)))
