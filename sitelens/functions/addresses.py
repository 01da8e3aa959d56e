"""Addresses in full, as browsers resolve them, as expressions on the row: no Python and no shuffle.

A link is taken apart by patterns, joined with its base, its path folded segment by segment, its path and query escaped, its host put
in lower case and the port of its scheme left out. A user's name in an address goes. Null where it is none of the web.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a link is made of, once trimmed: scheme, authority, path, query, fragment.
PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: The same for the authority: user, host, port.
AUTHORITY = r"^(?:.*@)?(\[[0-9a-fA-F:.]+\]|[^:\[\]]*)(?::([0-9]*))?$"
HOST = r"^(\[[0-9a-f:.]+\]|[^\x00-\x20\x7f\"#%/:<>?@\[\\\]^`{|}]+)$"
#: Characters that stay as they are in a path and in a query; all others become their bytes.
IN_PATH, IN_QUERY = r"!#$%&'()*+,\-./0-9:;=?@A-Z\[\\\]^_a-z|~", r"!#$%&()*+,\-./0-9:;=?@A-Z\[\\\]^_`a-z{|}~"
UP, HERE = r"(?i)^(\.|%2e){2}$", r"(?i)^(\.|%2e)$"


def cleaned(link: Column) -> Column:
    """Without controls and spaces at either end, and without line ends and tabs; backslashes of the path are slashes."""
    text = F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    head = F.regexp_extract(text, r"^([^?#]*)", 1)
    web = head.rlike(r"(?i)^(https?:|[^:/?#]*([/\\?#]|$))")
    return F.when(web, F.concat(F.translate(head, "\\", "/"), F.substring(text, F.length(head) + 1, F.length(text)))).otherwise(text)


def parts(text: Column) -> dict[str, Column]:
    """A cleaned address's parts; a missing scheme, authority, query or fragment is empty, with `has_` telling which there are."""
    found = {name: F.regexp_extract(text, PARTS, k) for k, name in enumerate(("scheme", "authority", "path", "query", "fragment"), 1)}
    rest = F.regexp_replace(text, "^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    return found | {"scheme": F.lower(found["scheme"]), "has_authority": rest.startswith("//")}


def escaped(text: Column, kept: str) -> Column:
    """text with all characters but those of a class as the bytes of their UTF-8."""
    runs = F.regexp_extract_all(text, F.lit(f"[{kept}]+|[^{kept}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{kept}]"), r).otherwise(F.regexp_replace(F.regexp_replace(F.url_encode(r), r"\+", "%20"), r"\*", "%2A"))), "")


def folded(path: Column) -> Column:
    """A path from the root without segments for `here` and `up`; what would lead above the root stays at it."""
    segments = F.split(path, "/", -1)
    dots = lambda s: s.rlike(UP) | s.rlike(HERE)
    step = lambda a, s: F.when(s.rlike(UP), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(s.rlike(HERE), a).otherwise(F.array_append(a, s))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), step)
    last = F.element_at(segments, -1)
    out = F.array_join(F.when(dots(last), F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def resolved(link: Column, base: Column) -> Column:
    """A link in full, seen from a base that is an address of the web."""
    b, x = parts(cleaned(base)), parts(cleaned(link))
    own = x["scheme"].isin("http", "https")
    # The base's scheme without an authority, as in `https:page`, is a relative link.
    alone = own & ((x["scheme"] != b["scheme"]) | x["has_authority"])
    foreign = (x["scheme"] != "") & ~own
    scheme = F.when(own, x["scheme"]).otherwise(b["scheme"])
    far = alone | x["has_authority"]
    # Of another scheme of the web without slashes the path begins with the host.
    bare = alone & ~x["has_authority"]
    authority = F.when(bare, F.regexp_extract(x["path"], "^/*([^/]*)", 1)).when(far, x["authority"]).otherwise(b["authority"])
    own_path = F.when(bare, F.regexp_replace(x["path"], "^/*[^/]*", "")).otherwise(x["path"])
    above = F.regexp_replace(b["path"], "[^/]*$", "")
    above = F.when(above == "", "/").otherwise(above)
    same = ~far & (own_path == "")
    path = F.when(far & (own_path == ""), "/").when(far | own_path.startswith("/"), own_path).when(same, F.when(b["path"] == "", "/").otherwise(b["path"])).otherwise(F.concat(above, own_path))
    query = F.when(same & (x["query"] == ""), b["query"]).otherwise(x["query"])
    host, port = F.lower(F.regexp_extract(authority, AUTHORITY, 1)), F.regexp_extract(authority, AUTHORITY, 2)
    number = port.try_cast("int")
    usual = (port == "") | (number == F.when(scheme == "http", 80).otherwise(443))
    netloc = F.when(F.coalesce(usual, F.lit(False)), host).otherwise(F.concat(host, F.lit(":"), number.cast("string")))
    sound = scheme.isin("http", "https") & ~foreign & authority.rlike(AUTHORITY) & host.rlike(HOST) & ((port == "") | (number <= 65535))
    out = F.concat(scheme, F.lit("://"), netloc, escaped(folded(path), IN_PATH), F.when(F.length(query) > 1, escaped(query, IN_QUERY)).otherwise(""), F.when(F.length(x["fragment"]) > 1, x["fragment"]).otherwise(""))
    return F.when(F.coalesce(sound, F.lit(False)), out)
