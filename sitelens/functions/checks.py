"""Checks of fetched pages as expressions over `h` (html), `t` (text), `url` and `title`, for either engine."""

from __future__ import annotations

from . import pages as P
from . import values as V


def any_of(q, c: str, patterns: list[str]) -> str:
    return q.has(c, "(?i)" + "|".join(f"(?:{p})" for p in patterns))


def n_of(q, c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST({q.has(c, f'(?i){p}')} AS INT)" for p in patterns) + ")"


def challenge(q) -> str:
    """Which mark of a challenge page comes first: titles before bodies; null without one."""
    cases = [f"WHEN contains(lower(title), '{p}') THEN 'challenge_title:{p}'" for p in V.CHALLENGE_TITLES]
    cases += [f"WHEN contains(lower(h), '{p}') THEN 'challenge_body:{p}'" for p in V.CHALLENGE_BODIES]
    return f"CASE {' '.join(cases)} END"


def page(q) -> dict[str, str]:
    contact_url = q.has("url", "(?i)contact|support|help|get-in-touch")
    shown, named = q.has("h", r"(?i)(?:tel:|href=\"tel:)?\+?[\d\s\-().]{10,}"), q.has("h", "(?i)phone|call|telephone|hotline|dial")
    emails = q.keep(q.all("t", V.EMAIL, 0), "x", "NOT " + q.has("x", f"(?i){V.NOBODYS}"))
    marks = " OR ".join(f"contains(h, '{m}')" for m in V.CHALLENGE_MARKS)
    return {
        "scripted": any_of(q, "h", V.SCRIPTED),
        "hidden_contact": f"({contact_url} AND ({q.has('h', f'(?i){V.EXPANDABLE}')} OR ({named} AND NOT {shown})))",
        "missing_page": any_of(q, "h", V.MISSING_PAGE),
        "contact_marks": n_of(q, "h", V.CONTACT_MARKS),
        "contact_page": f"(NOT {any_of(q, 'h', V.MISSING_PAGE)} AND {n_of(q, 'h', V.CONTACT_MARKS)} >= 3)",
        "challenge": challenge(q),
        "challenge_mark": f"({marks} OR (contains(h, 'Enable JavaScript') AND length(h) < 10000))",
        "challenge_policy": any_of(q, "h", V.POLICY_CHALLENGES),
        "challenge_browser": "(" + " OR ".join(f"contains(h, '{m}')" for m in V.WAITING_MARKS) + " OR (contains(h, 'Cloudflare') AND contains(h, 'Ray ID')))",
        "parked": any_of(q, "title", V.PARKED),
        "shop_title": "(" + " OR ".join(f"contains(lower(title), '{w}')" for w in V.SHOP_WORDS) + ")",
        "truncated": "(length(h) >= 20380)",
        "valid_emails": q.joined(emails, ","),
    }


def path(q, c: str) -> str:
    """The path of an absolute link or of one from the root; '/' where it has none."""
    found = q.first(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?(/[^?#]*)")
    return f"coalesce(nullif({found}, ''), '/')"


def in_scope(host: str, of: str) -> str:
    """Whether a host is another or one under it."""
    return f"({host} = {of} OR right({host}, length({of}) + 1) = concat('.', {of}))"


def links(q) -> dict[str, str]:
    """How many links of a page are in its host's scope, with and without www., and lead to products."""
    hrefs = q.all("h", V.LINK_HREF)
    bare = lambda x: q.sub(x, r"^www\.", "")
    of = lambda x: f"coalesce(nullif({P.host(q, x)}, ''), {P.host(q)})"
    product = f"(NOT {any_of(q, path(q, 'x'), V.NEVER_PRODUCT)} AND {any_of(q, path(q, 'x'), V.PRODUCT_PATHS)})"
    return {
        "links": q.size(hrefs),
        "in_scope": q.size(q.keep(hrefs, "x", in_scope(of("x"), P.host(q)))),
        "in_scope_bare": q.size(q.keep(hrefs, "x", in_scope(bare(of("x")), bare(P.host(q))))),
        "products": q.size(q.keep(hrefs, "x", product)),
    }


def resolved(q, href: str, base: str = "url") -> str:
    """A link as an absolute one without its fragment; null where it leads to no page.

    Segments `.` and `..` are kept as they are."""
    link = q.sub(f"trim({href})", "#.*$", "")
    origin, scheme = q.first(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"), q.first(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)//")
    folder, page_ = q.first(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*/)"), q.sub(base, "[?#].*$", "")
    return (f"CASE WHEN {href} IS NULL OR {link} = '' THEN NULL WHEN {q.has(link, '(?i)^https?://')} THEN {link} WHEN {q.has(link, '^//')} THEN concat({scheme}, {link}) "
            f"WHEN {q.has(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:')} THEN NULL WHEN {q.has(link, '^/')} THEN concat({origin}, {link}) WHEN {q.has(link, '^[?]')} THEN concat({page_}, {link}) "
            f"ELSE concat({origin}, coalesce(nullif({folder}, ''), '/'), {link}) END")  # fmt: skip


def site_links(q) -> dict[str, str]:
    """The distinct pages of a page's own host that it links to, without a slash at the end."""
    hrefs = q.all("h", V.LINK_HREF)
    own = q.keep(q.each(hrefs, "x", resolved(q, "x")), "y", f"y IS NOT NULL AND {P.host(q, 'y')} = {P.host(q)}")
    found = q.sorted_distinct(q.each(own, "z", q.sub("z", "/$", "")))
    return {"site_links": q.joined(found, " "), "n_site_links": q.size(found)}
