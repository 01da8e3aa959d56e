"""When a domain was registered: from a registry's JSON, else from its text, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V

RDAP = "events array<struct<eventAction: string, eventDate: string>>, entities array<struct<roles: array<string>, handle: string, vcardArray: array<string>>>, status array<string>"


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern, in their order, that a text has."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, f"(?i){p}", 1)), F.lit("")) for p in patterns))


def iso(text: Column) -> Column:
    """A date in one of five forms as an ISO stamp; null for any other."""
    day = F.trim(text)
    at = lambda p, *order: F.concat(F.concat_ws("-", *order), F.lit("T00:00:00Z"))
    part = lambda p, k: F.regexp_extract(day, p, k)
    two = lambda c: F.lpad(c, 2, "0")
    months = F.create_map(*(F.lit(x) for k, m in enumerate(V.MONTHS, 1) for name in {m, m[:3]} for x in (name, f"{k:02}")))
    short = F.create_map(*(F.lit(x) for k, m in enumerate(V.MONTHS, 1) for x in (m[:3], f"{k:02}")))
    stamp, slashed, dotted = r"^\d{4}-\d{2}-\d{2}(?:T[\d:]+Z?)?\z", r"^(\d{4})/(\d{2})/(\d{2})\z", r"^(\d{2})\.(\d{2})\.(\d{4})\z"
    named, spoken = r"^(\d{1,2})[-\s]([A-Za-z]{3})[-\s](\d{4})\z", r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\z"
    return (
        F.when(day.rlike(stamp), F.when(day.contains("T"), day).otherwise(F.concat(day, F.lit("T00:00:00Z"))))
        .when(day.rlike(slashed), at(slashed, part(slashed, 1), part(slashed, 2), part(slashed, 3)))
        .when(day.rlike(dotted), at(dotted, part(dotted, 3), part(dotted, 2), part(dotted, 1)))
        .when(day.rlike(named) & short[F.lower(part(named, 2))].isNotNull(), at(named, part(named, 3), short[F.lower(part(named, 2))], two(part(named, 1))))
        .when(day.rlike(spoken) & months[F.lower(part(spoken, 1))].isNotNull(), at(spoken, part(spoken, 3), months[F.lower(part(spoken, 1))], two(part(spoken, 2))))
    )


def from_json(body: Column) -> Column:
    """struct(created, expires, changed, registrar, status) of a registry's JSON: the first event of each kind, and the
    registrar's card name, or else its handle."""
    x = F.from_json(body, RDAP)
    event = lambda *names: F.try_element_at(F.filter(x["events"], lambda e: e["eventAction"].isin(*names)), F.lit(1))["eventDate"]
    registrars = F.filter(x["entities"], lambda e: F.array_contains(e["roles"], "registrar"))
    cards = F.transform(registrars, lambda e: F.from_json(F.try_element_at(e["vcardArray"], F.lit(2)), "array<array<string>>"))
    names = F.transform(cards, lambda c: F.try_element_at(F.try_element_at(F.filter(c, lambda v: v[0] == "fn"), F.lit(1)), F.lit(4)))
    first = lambda xs: F.try_element_at(F.filter(xs, lambda v: v.isNotNull()), F.lit(1))
    handles = F.transform(registrars, lambda e: e["handle"])
    return F.struct(event("registration").alias("created"), event("expiration").alias("expires"), event("last changed", "last update of RDAP database").alias("changed"), F.coalesce(first(names), first(handles)).alias("registrar"), x["status"].alias("status"))


def server(tld: Column) -> Column:
    """Where a top-level domain's registry answers: its own server, another for those not listed, null where there is none."""
    own = F.create_map(*(F.lit(x) for k, v in V.RDAP_SERVERS.items() if v for x in (k, v)))
    return F.when(tld.isin([k for k, v in V.RDAP_SERVERS.items() if v is None]), F.lit(None)).otherwise(F.coalesce(own[tld], F.lit(V.RDAP_ELSEWHERE)))


def listed(tld: Column) -> Column:
    return F.coalesce(tld.isin([k for k, v in V.RDAP_SERVERS.items() if v]), F.lit(False))


def read_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what a registry's text says: text_created, text_expires, text_registrar, text_error."""
    found = {"text_created": V.CREATED, "text_expires": V.EXPIRES, "text_registrar": V.REGISTRARS}
    df = df.withColumns({k: first_match(F.col(text), p) for k, p in found.items()})
    df = df.withColumns({k: iso(F.col(k)) for k in ("text_created", "text_expires")})
    return df.withColumn("text_error", F.when(F.col("text_created").isNull() & F.col("text_expires").isNull(), V.NO_DATES))


def looked_up(df: DataFrame) -> DataFrame:
    """(domain, answered, body, text, ...) with created, expires, changed, registrar, status, error, server, source: by the
    registry's JSON where there is a server and it answered, else by its text."""
    df = read_text(df).withColumns({"json": from_json(F.col("body")), "at": server(F.lower(F.substring_index("domain", ".", -1)))})
    df = df.withColumns({"by_json": F.col("at").isNotNull() & F.coalesce("answered", F.lit(False)), "by_text": F.col("text_created").isNotNull()})
    j, t = F.col("by_json"), F.col("by_text")
    return df.withColumns({
        "created": F.when(j, F.col("json.created")).when(t, F.col("text_created")), "expires": F.when(j, F.col("json.expires")).when(t, F.col("text_expires")), "changed": F.when(j, F.col("json.changed")),
        "registrar": F.when(j, F.col("json.registrar")).otherwise(F.col("text_registrar")), "status": F.when(j, F.col("json.status")).otherwise(F.array().cast("array<string>")),
        "error": F.when(~j & ~t, F.coalesce("text_error", F.lit(V.NO_REGISTRATION))), "server": F.when(j, F.col("at")), "source": F.when(j, "rdap").when(t, "whois"),
    }).drop("json", "at", "by_json", "by_text", "text_created", "text_expires", "text_registrar", "text_error")


def age_days(created: Column, as_of_seconds: int) -> Column:
    return F.floor((F.lit(as_of_seconds) - F.unix_seconds(F.try_to_timestamp(created))) / 86400).cast("int")
