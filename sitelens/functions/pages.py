"""Page features and signals as expressions over `h` (html) and `url`, for either engine.

Text is reduced with lazy patterns, which need no stack however many `<` a script holds.
"""

from __future__ import annotations

from . import values as V

#: Steps of character references in the order in which they are decoded.
REFERENCES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def stripped(q, h: str, blocks=("script", "style"), fold: bool = False) -> str:
    for tag in blocks:
        h = q.sub(h, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    h = q.sub(h, "<[^>]+>", " ")
    for name, c in REFERENCES:
        h = q.sub(h, ("(?i)" if fold else "") + name, c) if fold else f"replace({h}, '{name}', '{c}')"
    h = f"replace({h}, '&#39;', {apostrophe(q)})"
    if fold:
        h = f"replace({h}, '&apos;', {apostrophe(q)})"
    return f"trim({q.sub(h, chr(92) + 's+', ' ')})"


def apostrophe(q) -> str:
    return '"\'"' if q.name == "spark" else "''''"


def plain(q) -> str:
    return stripped(q, "h")


def compared(q) -> str:
    return stripped(q, "h", ("script", "style", "noscript", "svg", "nav", "footer"), fold=True)


def readable(q) -> str:
    """The text for readers that take structure: blocks on lines of their own, links' numbers and addresses named."""
    h = "h"
    for tag in ("script", "style"):
        h = q.sub(h, rf"(?is)<{tag}\b.*?</{tag}>", "")
    h = q.sub(h, r"(?s)<!--.*?-->", "")
    for tag in ("noscript", "svg", "head"):
        h = q.sub(h, rf"(?is)<{tag}\b.*?</{tag}>", "")
    h = f"trim({q.sub(h, chr(92) + 's+', ' ')})"
    one = q.group(1)
    for p, r in ((r"""(?i)href=["']tel:([^"']+)["']""", f"PHONE: {one} "), (r"""(?i)href=["']mailto:([^"']+)["']""", f"EMAIL: {one} "), (r"""(?i)\stel=["']([^"']+)["']""", f" PHONE: {one} "),
                 (r"""(?i)href=["']https?://(?:api\.)?whatsapp\.com/send\?phone=\s*(\d+)["']""", f"WHATSAPP: +{one} "), (r"""(?i)href=["']https?://wa\.me/(\d+)["']""", f"WHATSAPP: +{one} ")):
        h = q.sub(h, p, r)
    h = f"replace({q.sub(h, '(?i)<(h[1-6]|div|section|article|p|li|tr|footer|header)[^>]*>', '@@')}, '@@', chr(10))".replace("'@@'", q.quoted("\x01"))
    h = q.sub(h, "<[^>]+>", " ")
    for name, c in REFERENCES:
        h = f"replace({h}, '{name}', '{c}')"
    h = f"replace({h}, '&#39;', {apostrophe(q)})"
    h = q.sub(q.sub(h, r"[ \t]+", " "), r"\n\s*\n", chr(2))
    h = f"replace({q.sub(f'replace({h}, {q.quoted(chr(2))}, chr(10))', r'\n ', chr(2))}, {q.quoted(chr(2))}, chr(10))"
    return q.sub(h, r"^\s+|\s+$", "")


def words(q, text: str) -> str:
    return q.size(q.keep(q.split(text, r"\s+"), "w", "w <> ''"))


def host(q, url: str = "url") -> str:
    return f"lower({q.first(url, r'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)')})"


#: Headings, and blocks of the body, that a page's features keep.
HEADINGS, BLOCKS = 20, 20


def heading_list(q) -> str:
    """The texts of the first headings without markup in them, h1 before h2 before h3."""
    own = lambda k: q.slice(q.keep(q.each(q.all("h", rf"(?i)<h{k}[^>]*>([^<]*)</h{k}>"), "x", q.sub("x", r"^\s+|\s+$", "")), "y", "y <> ''"), HEADINGS)
    return q.slice(q.concat(*map(own, (1, 2, 3))), HEADINGS)


def block_list(q) -> str:
    """The first block elements of the body, by name."""
    body = f"CASE WHEN {q.has('h', '(?is)<body[^>]*>.*</body>')} THEN {q.first('h', '(?is)<body[^>]*>(.*)</body>')} ELSE h END"
    return q.slice(q.each(q.all(body, V.BLOCK_TAGS), "x", "lower(x)"), BLOCKS)


def features(q) -> dict[str, str]:
    """Over h and t, the text as comparisons take it; lists stay lists."""
    count = lambda p: f"CAST({q.count('h', p)} AS INTEGER)"
    depth = f"least({count('(?i)<div')}, 50)"
    out = {
        "title": f"CASE WHEN {q.has('h', '(?i)<title[^>]*>[^<]*</title>')} THEN trim({q.first('h', '(?i)<title[^>]*>([^<]*)</title>')}) END",
        "word_count": words(q, "t"),
        "text_length": "CAST(length(t) AS INTEGER)",
        "html_sha256": q.sha256("h"),
        "text_sha256": q.sha256("t"),
        **{f"h{k}": count(rf"(?i)<h{k}[^>]*>[^<]*</h{k}>") for k in (1, 2, 3)},
        "headings": heading_list(q),
        "links": count(V.COMPARED_LINK),
        "forms": count("(?i)<form"),
        "buttons": count("(?i)<button"),
        "inputs": count("(?i)<input"),
        "images": count("(?i)<img"),
        "passwords": count(V.COMPARED_PASSWORD),
        "max_depth": depth,
        "avg_depth": f"CAST(floor({depth} / CAST(2 AS DOUBLE) + 0.5) AS INTEGER)",
        "generator": f"nullif({q.first('h', V.GENERATOR)}, '')",
        "blocks": block_list(q),
    }
    return out | {f"tag_{t}": count(rf"(?i)<{t}[\s>]") for t in V.TAGS}


def flat_features(q) -> dict[str, str]:
    return {c: q.joined(c, "|") if c in ("headings", "blocks") else c for c in features(q)}


def signals(q) -> dict[str, str]:
    """Redirects, forms, third parties, content and policy links; flags as booleans."""
    has, count = (lambda p, c="h": q.has(c, p)), (lambda p, c="h": f"CAST({q.count(c, p)} AS INTEGER)")
    actions = q.all("h", V.FORM_ACTION)
    sources = q.all("h", V.SCRIPT_SOURCE)
    outside = lambda xs: q.keep(q.each(xs, "x", host(q, "x")), "y", f"y <> '' AND y <> {host(q)}")
    inline = q.all("h", V.INLINE_SCRIPT)
    return {
        "host": host(q),
        "https": q.has("url", "(?i)^https://"),
        "meta_refresh": has(V.META_REFRESH),
        "js_redirect": q.has(f"substr(h, 1, {V.REDIRECT_WINDOW})", V.JS_REDIRECT),
        "passwords": count(V.PASSWORD_INPUT),
        "emails": count(V.EMAIL_INPUT),
        "login_form": "(" + has(V.PASSWORD_INPUT) + " AND (" + has(V.SUBMIT_INPUT) + " OR " + has(r"(?i)<button[^>]*>") + "))",
        "external_actions": q.distinct_size(outside(actions)),
        "script_hosts": f"least({q.distinct_size(outside(sources))}, 20)",
        "obfuscated": f"{q.size(q.keep(inline, 'x', f'length(x) > {V.LONG_SCRIPT}'))} > 0",
        "evaluates": has(V.EVALUATES),
        "urgency": count(V.URGENCY, "t"),
        "discount": count(V.DISCOUNT, "t"),
        "payment": has(V.PAYMENT, "t"),
        "impersonation": has(V.IMPERSONATION, "t"),
        "word_count": words(q, "t"),
        "privacy_link": has(r"""(?i)href=["'][^"']*(/privacy|/datenschutz)"""),
        "terms_link": has(r"""(?i)href=["'][^"']*/terms"""),
        "refund_link": has(r"""(?i)href=["'][^"']*/refund"""),
        "contact": has(V.EMAIL, "t"),
        "about": has(r"(?i)about us", "t"),
    }


#: Characters of a text that may hold a price, and of a price as shown.
PRICE_SOURCE, PRICE_SHOWN = 200, 50


def priced(q, c: str) -> str:
    """Which of the ordered price patterns is the first that a text has, from 0; null without one or for a longer text."""
    clean = f"trim({q.sub(c, chr(92) + 's+', ' ')})"
    return f"CASE WHEN length({c}) > {PRICE_SOURCE} THEN NULL " + " ".join(f"WHEN {q.has(clean, p)} THEN {k}" for k, (p, _) in enumerate(V.price_patterns())) + " END"


def price(q, c: str, k: str) -> dict[str, str]:
    """Currency, amount and text of a price, where k is priced() of the text; commas and points before three digits
    separate thousands."""
    tried = V.price_patterns()
    clean = f"trim({q.sub(c, chr(92) + 's+', ' ')})"
    pattern = q.at(q.array(*(q.pattern(p) for p, _ in tried)), k)
    digits = q.sub_first(q.ungrouped(q.ungrouped(f"regexp_extract({clean}, {pattern}, 1)", ","), "."), ",", ".")
    return {"currency": q.at(q.array(*(f"'{x}'" for _, x in tried)), k), "amount": f"try_cast({q.first(digits, '^([0-9]*[.]?[0-9]*)')} AS DOUBLE)",
            "price_text": f"substr(trim(regexp_extract({clean}, {pattern}, 0)), 1, {PRICE_SHOWN})"}


def urls(q, u: str = "url") -> dict[str, str]:
    clean = q.sub(f"lower(trim({u}))", r"^[a-z][a-z0-9+.-]*://", "")
    clean = q.sub(q.sub(clean, r"^www\.", ""), r"/+$", "")
    domain = q.first(clean, r"^[^/?#]+", 0)
    return {
        "clean_url": clean, "domain": domain, "domain_id": f"substr({q.sha256(domain)}, 1, 16)", "host": host(q, u),
        "site": f"coalesce(nullif({q.sub(host(q, u), r'^www[.]', '')}, ''), {domain})", "tld": q.first(domain, r"([^.]*)$"), "path": q.first(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"),
        "normalized": f"CASE WHEN {q.has(f'trim({u})', '^[a-zA-Z][a-zA-Z0-9+.-]*:')} THEN trim({u}) ELSE concat('https://', trim({u})) END",
    }
