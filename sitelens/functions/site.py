"""Signals of a scan, for either engine: what its home page shows, and what its other records add.

`page` is a projection of one page over `h` (html), `t` (text), `url`; `joined` one over a row that has the
page's columns and those of its fetch, records and probes.
"""

from __future__ import annotations

import re

from ..sources import ingest
from . import pages as P
from . import values as V

SNIPPET = 500
WINDOW, FRONT = 50_000, 10_000


def bare(q, host: str) -> str:
    return q.sub(host, r"^www\.", "")


def head(q) -> str:
    """The head element, or the first 5000 characters of a page without one."""
    return f"coalesce(nullif({q.first('h', '(?is)<head[^>]*>(.*?)</head>', 0)}, ''), substr(h, 1, 5000))"


def missing(c: str) -> str:
    return f"nullif({c}, '')"


def page(q) -> dict[str, str]:
    """What the home page shows: forms, scripts, content. Null html is no page."""
    s = P.signals(q)
    outside = lambda xs: q.keep(q.each(xs, "x", P.host(q, "x")), "y", f"y <> '' AND y <> {P.host(q)}")
    actions = q.all("h", V.FORM_ACTION)
    sources = q.all("h", V.SCRIPT_SOURCE)
    return {
        "url": "url",
        "input_host": P.host(q),
        "size": "CAST(length(h) AS INT)",
        "html_title": f"CASE WHEN {q.has('h', '(?i)<title[^>]*>[^<]*</title>')} THEN {q.first('h', '(?i)<title[^>]*>([^<]*)</title>')} END",
        "word_count": f"CASE WHEN t <> '' THEN {P.words(q, 't')} END",
        "meta_refresh_present": s["meta_refresh"],
        "js_redirect_hint": s["js_redirect"],
        "password_input_count": s["passwords"],
        "email_input_count": s["emails"],
        "login_form_present": s["login_form"],
        "external_form_actions": q.distinct(outside(actions)),
        "external_script_domains": q.slice(q.distinct(outside(sources)), 20),
        "obfuscation_hint": s["obfuscated"],
        "eval_atob_hint": s["evaluates"],
        "urgency_score": s["urgency"],
        "extreme_discount_score": s["discount"],
        "payment_keyword_hint": s["payment"],
        "impersonation_hint": s["impersonation"],
    }


def joined(q) -> dict[str, str]:
    """The whole row of signals; `robots` has page_id, robots_status, robots_ok, disallow_count, robots_sitemaps."""
    final = bare(q, P.host(q, "final_url"))
    has = {k: f"coalesce({q.has('headers', '(?im)^' + name + ':')}, false)" for k, name in V.SECURITY_HEADERS.items()}
    ok = "coalesce(status_code BETWEEN 200 AND 399, false)"
    dns_ok = "(coalesce(a_records, '') <> '' OR coalesce(aaaa_records, '') <> '')"
    cross = f"coalesce({final} <> {bare(q, 'input_host')}, false)"
    expiry = f"CAST(floor((valid_to - {ingest.AS_OF_SECONDS}) / CAST({ingest.DAY} AS DOUBLE)) AS INT)"
    age = f"CAST(floor(({ingest.AS_OF_SECONDS} - registered_at) / CAST({ingest.DAY} AS DOUBLE)) AS INT)"
    return {
        "status_code": f"CASE WHEN NOT {ok} AND coalesce(seen_active, false) THEN coalesce(nullif(seen_status, 0), status_code) ELSE status_code END", "is_active": f"({ok} OR coalesce(seen_active, false))", "latency_ms": "latency_ms", "bytes": "size", "content_type": "content_type", "final_url": "final_url", "redirect_chain_length": "coalesce(hops, 0)",
        "html_title": "html_title", "homepage_text_word_count": "word_count", "bot_protection_detected": f"(coalesce(status_code = 403, false) AND {dns_ok} AND coalesce(https_ok, false))",
        "cross_domain_redirect": cross, "mismatch_input_vs_final_domain": cross, "meta_refresh_present": "meta_refresh_present", "js_redirect_hint": "js_redirect_hint",
        "a_records": "a_records", "aaaa_records": "aaaa_records", "ns_records": "ns_records", "mx_present": "coalesce(mx_present, false)", "dns_ok": dns_ok,
        "https_ok": "coalesce(https_ok, false)", "cert_issuer": "cert_issuer", "cert_valid_from": "valid_from", "cert_valid_to": "valid_to", "days_to_expiry": expiry, "expiring_soon": f"coalesce({expiry} < 14, false)",
        **{f"{k}_present": v for k, v in has.items()},
        "robots_fetched": "coalesce(robots_ok, false)", "robots_status": "robots_status", "sitemap_urls_found": "sitemap_urls_found", "sitemap_url_count": "sitemap_url_count", "disallow_count_for_user_agent_star": "coalesce(disallow_count, 0)",
        "found_paths": "coalesce(found_paths, '')", "n_found_paths": "coalesce(n_found_paths, 0)", "privacy_snippet": f"substr(privacy_snippet, 1, {SNIPPET})", "terms_snippet": f"substr(terms_snippet, 1, {SNIPPET})", "contact_snippet": f"substr(contact_snippet, 1, {SNIPPET})",
        "password_input_count": "password_input_count", "email_input_count": "email_input_count", "login_form_present": "login_form_present", "external_form_actions": "external_form_actions",
        "external_script_domains": "external_script_domains", "obfuscation_hint": "obfuscation_hint", "eval_atob_hint": "eval_atob_hint",
        "urgency_score": "urgency_score", "extreme_discount_score": "extreme_discount_score", "payment_keyword_hint": "payment_keyword_hint", "impersonation_hint": "impersonation_hint",
        "registered_at": "registered_at", "expires_at": "expires_at", "domain_age_days": age, "domain_age_years": f"round({age} / CAST(365.25 AS DOUBLE), 1)", "registrar": "registrar", "rdap_available": "error IS NULL", "rdap_error": "error",
        "input_host": "input_host",
    }


def assembled(q, source) -> str:
    """Every record of a scan beside its page; source names the tables page, fetches, dns, tls, registration, robots, sitemaps, probes.

    Only the page's narrow columns meet the other records, never its html."""
    found = "status_code BETWEEN 200 AND 399"
    snippet = lambda word, *before: q.last_by("text", "pos", f"{found} AND contains(path, '{word}')" + "".join(f" AND NOT contains(path, '{b}')" for b in before))
    origin = q.first("p.url", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)")
    # A place that robots.txt names is listed once.
    well_known = lambda path: f"CASE WHEN NOT contains(concat(',', coalesce(b.robots_sitemaps, ''), ','), concat(',', {origin}, '{path},')) THEN concat({origin}, '{path}') END"
    index, n = "contains(content, '<sitemapindex')", f"{q.count('content', '(?i)<url>')}"
    return f"""WITH pr AS (SELECT page_id, {q.listagg('path', 'pos', found)} AS found_paths, CAST(count(*) FILTER (WHERE {found}) AS INT) AS n_found_paths, {snippet('privacy')} AS privacy_snippet,
        {snippet('terms', 'privacy')} AS terms_snippet, {snippet('contact', 'privacy', 'terms')} AS contact_snippet FROM {source('probes')} GROUP BY page_id),
      sm AS (SELECT page_id, CAST(nullif(sum(CASE WHEN status_code BETWEEN 200 AND 399 AND NOT {index} THEN {n} ELSE 0 END), 0) AS INT) AS sitemap_url_count
        FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM {source('sitemaps')}) x WHERE k <= 5 GROUP BY page_id)
      SELECT p.*, f.status_code, f.final_url, f.content_type, f.hops, f.latency_ms, f.headers, f.seen_active, f.seen_status, d.a_records, d.aaaa_records, d.ns_records, d.mx_present, l.https_ok, l.cert_issuer, l.valid_from, l.valid_to,
        r.registered_at, r.expires_at, r.registrar, r.error, r.source, b.robots_status, b.robots_ok, b.disallow_count,
        concat_ws(',', nullif(b.robots_sitemaps, ''), {well_known('/sitemap.xml')}, {well_known('/sitemap_index.xml')}) AS sitemap_urls_found,
        sm.sitemap_url_count, pr.found_paths, pr.n_found_paths, pr.privacy_snippet, pr.terms_snippet, pr.contact_snippet
      FROM {source('page')} p LEFT JOIN {source('fetches')} f ON p.page_id = f.page_id LEFT JOIN {source('dns')} d ON p.page_id = d.page_id LEFT JOIN {source('tls')} l ON p.page_id = l.page_id
        LEFT JOIN {source('registration')} r ON p.page_id = r.page_id LEFT JOIN {source('robots')} b ON p.page_id = b.page_id LEFT JOIN sm ON p.page_id = sm.page_id LEFT JOIN pr ON p.page_id = pr.page_id"""  # fmt: skip


#: For each pattern of suspicious content, words of which a text in lower case has one if it matches; contains() is
#: much faster than a pattern.
GUARDS = [
    "hahaha hehe hihi lol wow", "· •", "curved straight wide", "fragrance smell", "quality", "direct", "limited flash clearance", "very", "shop store", "ship", "size", "chart", "only just", "order buy", "streetwear vintage", "the",
    "very so", "stars excellent perfect star", "good", "suitable perfect",
]
SECOND_GUARDS = {4: "cheap low discount", 5: "factory warehouse", 7: "good nice beautiful", 8: "buy purchase", 9: "fast quick speed", 10: "asian china chinese", 11: "please", 12: "left remaining piece item", 13: "free gift", 14: "casual fashion",
                 15: "very so too", 17: "fast quick", 18: "recommend", 19: "daily everyday"}


def may_be(low: str, k: int) -> str:
    """Whether a text in lower case may have the k-th suspicious pattern."""
    any_of = lambda words: "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"
    second = SECOND_GUARDS.get(k, "")
    return any_of(GUARDS[k].split()) + (f" AND {any_of(second.split())}" if second else "")


def read_for_builders(q) -> dict[str, str]:
    """Columns of a page that generated() reads: its front and, where that doesn't hold it, its head; both in lower case too."""
    front = f"CASE WHEN length(h) <= {WINDOW} THEN h ELSE concat(substr(h, 1, {WINDOW}), chr(10), {head(q)}) END"
    return {"head": head(q), "front": front, "low_front": f"lower({front})", "low": "lower(h)", "body": "CASE WHEN t <> '' THEN t ELSE h END", "low_body": "lower(CASE WHEN t <> '' THEN t ELSE h END)"}


def holds(q, c: str, low: str, pattern: str) -> str:
    """Whether a text has a pattern in any case; plain words are looked up in the text in lower case, which takes no pattern."""
    if re.fullmatch(r"(?:[a-z0-9_/ -]|\\\.|\|)+", pattern):
        return "(" + " OR ".join(f"contains({low}, '{x}')" for x in pattern.replace("\\.", ".").split("|")) + ")"
    found = q.has(c, f"(?i){pattern}")
    return f"(contains({low}, 'generator') AND {found})" if pattern.startswith("generator") else found


def generated(q) -> dict[str, str]:
    """What of the page itself speaks for a generated one, over h, t, url and read_for_builders()."""
    quote = q.quoted
    builder = [q.struct(name=quote(n), kind=quote(k), score=str(s), hit=holds(q, "front", "low_front", p)) for p, n, k, s in V.SITE_BUILDERS]
    builders = q.keep(q.array(*builder), "x", "x.hit")
    markers = q.keep(q.array(*(q.struct(d=quote(d), score=str(s), hit=holds(q, "h", "low", p)) for p, d, s in V.AI_MARKERS)), "x", "x.hit")
    suspicious = q.keep(q.array(*(q.struct(d=quote(d), score=str(s), n=f"CASE WHEN {may_be('low_body', k)} THEN CAST({q.count('body', '(?i)' + p)} AS INT) ELSE 0 END", least=str(m)) for k, (p, d, s, m) in enumerate(V.SUSPICIOUS))), "x", "x.n >= x.least")
    title = q.first("head", "(?i)<title[^>]*>([^<]+)</title>")
    seo = [
        f"CASE WHEN {q.has('head', V.SEO_TITLE)} THEN CASE WHEN {title} = '' OR {q.has(f'trim({title})', V.GENERIC_TITLES)} THEN 5 ELSE 20 END ELSE 0 END",
        f"CASE WHEN {q.has('head', V.SEO_DESCRIPTION)} THEN 20 WHEN {q.has('head', V.SEO_SHORT_DESCRIPTION)} THEN 5 ELSE 0 END",
        *(f"CASE WHEN {q.has('head', p)} THEN {n} ELSE 0 END" for p, n in V.SEO_HEAD), *(f"CASE WHEN {q.has('h', p)} THEN {n} ELSE 0 END" for p, n in V.SEO_PAGE),
    ]
    plain = " + ".join(f"CASE WHEN {q.has('head', '(?i)' + p)} OR {q.has(f'substr(h, 1, {FRONT})', '(?i)' + p)} THEN 1 ELSE 0 END" for p in V.BOILERPLATE)
    of_host = lambda what: "CASE " + " ".join(f"WHEN {q.has(P.host(q), '(?i)[.]' + re.escape(s) + chr(92) + 'z')} THEN {quote(x[0]) if what == 'name' else x[1]}" for s, *x in V.FREE_HOSTS) + " END"
    return {
        "builders": builders, "markers": markers, "suspicious": suspicious, "seo_score": f"CAST(least(100, {' + '.join(seo)}) AS INT)", "is_boilerplate": f"({plain}) >= 2",
        "favicon_tag": q.has("head", V.FAVICON), "free_hosting": of_host("name"), "hosting_score": f"coalesce({of_host('score')}, 0)",
        "tailwind": q.has("h", "(?i)tailwind|tw-"), "has_page": "coalesce(h, '') <> ''", "text_length": "CAST(length(t) AS INT)",
    }


def header(q, name: str) -> str:
    """The value of a header, '' without it."""
    return q.first("coalesce(headers, '')", rf"(?im)^{name}:[ \t]*(.*)$")


def likelihood(q) -> dict[str, str]:
    """The deterministic likelihood, over generated() and a scan's headers, favicon_ok, robots_valid and sitemap_valid."""
    quote = q.quoted
    most = "greatest(0, coalesce(" + ("array_max(transform(builders, x -> x.score))" if q.name == "spark" else "list_max(list_transform(builders, lambda x: x.score))") + ", 0))"
    total = lambda xs: q.sum(q.each(xs, "x", "x.score"))
    server, powered = (f"lower({header(q, name)})" for name in ("server", "x-powered-by"))
    favicon = "(coalesce(favicon_tag, false) OR coalesce(favicon_ok, false))"
    robots, sitemap = "coalesce(robots_valid, false)", "coalesce(sitemap_valid, false)"
    # The subscore is held to 100 after each mark, which for points that only add is the same as once at the end.
    markup = f"CAST(least(100, {most} + {total('markers')} + least({V.SUSPICIOUS_CAP}, {total('suspicious')})) AS INT)"
    infra = f"CAST(least(100, CASE WHEN {robots} THEN 0 ELSE 20 END + CASE WHEN {sitemap} THEN 0 ELSE 15 END + CASE WHEN {favicon} THEN 0 ELSE 10 END + hosting_score + floor((100 - seo_score) * CAST(0.25 AS DOUBLE) + CAST(0.5 AS DOUBLE)) + CASE WHEN is_boilerplate THEN 20 ELSE 0 END) AS INT)"
    names = q.each("builders", "x", "replace(lower(x.name), ' ', '-')")
    hints = q.distinct(q.concat(names, q.compact(q.array(
        f"CASE WHEN contains({server}, 'vercel') THEN 'vercel' END", f"CASE WHEN contains({server}, 'netlify') THEN 'netlify' END", f"CASE WHEN contains({powered}, 'next.js') THEN 'next.js' END", "CASE WHEN tailwind THEN 'tailwind' END"))))
    first = lambda field: f"{q.at('builders', 0)}.{field}"
    kind = {n: next(k for _, m, k, _ in V.SITE_BUILDERS if m == n) for _, n, _, _ in V.SITE_BUILDERS}
    built = f"CASE WHEN {q.size('builders')} = 0 THEN NULL WHEN {first('kind')} = 'builder' THEN concat('Built with ', {first('name')}, ' (no-code builder)') WHEN {first('kind')} = 'framework' THEN concat('Uses ', {first('name')}, ' framework') ELSE concat('Powered by ', {first('name')}) END"
    assert all(kind[n] == k for _, n, k, _ in V.SITE_BUILDERS)
    seen = q.slice(q.each("suspicious", "x", f"CASE WHEN x.n >= 3 THEN concat(x.d, ' (found ', {q.string('x.n')}, ' instances)') ELSE x.d END"), 2)
    markup_reasons = q.slice(q.concat(q.compact(q.array(built)), q.each("markers", "x", "x.d"), seen), 5)
    infra_reasons = q.slice(q.compact(q.array(
        f"CASE WHEN NOT {robots} THEN 'Missing robots.txt' END", f"CASE WHEN NOT {sitemap} THEN 'Missing sitemap.xml' END", f"CASE WHEN NOT {favicon} THEN 'Missing favicon' END",
        "CASE WHEN free_hosting IS NOT NULL THEN concat('Hosted on ', free_hosting, ' (free tier)') END", "CASE WHEN seo_score < 30 THEN 'Minimal SEO setup' END", "CASE WHEN is_boilerplate THEN 'Generic boilerplate structure detected' END")), 4)
    # Without a page the subscores are in the middle, and nothing is sure.
    whole = lambda x, other: f"CASE WHEN has_page THEN {x} ELSE {other} END"
    unknown = q.array("'Analysis unavailable'")
    return {
        "markup": whole(markup, AI_CONTENT), "infrastructure": whole(infra, AI_CONTENT), "has_page": "has_page", "generator_meta": first("name"), "tech_hints": hints, "ai_markers": q.each("markers", "x", "x.d"), "suspicious_content_patterns": q.each("suspicious", "x", "x.d"),
        "reasons": whole(q.slice(q.concat(markup_reasons, infra_reasons), 6), unknown), "has_robots_txt": robots, "has_sitemap": sitemap, "has_favicon": favicon, "free_hosting": "free_hosting", "seo_score": "seo_score", "is_boilerplate": "is_boilerplate",
        "text_length": "text_length",
    }


AI_CONTENT = 50
AI_SCORE = f"CASE WHEN NOT has_page THEN {AI_CONTENT} ELSE CAST(floor(CAST(0.55 AS DOUBLE) * {AI_CONTENT} + CAST(0.25 AS DOUBLE) * markup + CAST(0.20 AS DOUBLE) * infrastructure + CAST(0.5 AS DOUBLE)) AS INT) END"
AI_CONFIDENCE = "CASE WHEN NOT has_page THEN 0 ELSE CAST(greatest(0, 20 - CASE WHEN text_length < 500 THEN 30 WHEN text_length < 1000 THEN 15 ELSE 0 END) AS INT) END"
AI_NOTES = "CASE WHEN NOT has_page THEN 'no page' ELSE concat('markup and infrastructure only', CASE WHEN text_length < 500 THEN '; Low text volume on homepage' WHEN text_length < 1000 THEN '; Limited text content' ELSE '' END) END"


def layered(q) -> dict[str, str]:
    """What of the page itself a second reading looks at: its own builders, marks and search-engine points, over h and low, h in lower case."""
    count = lambda conditions: "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"
    return {
        "generator_meta": missing(q.first("h", V.LAYERED_GENERATOR)), "n_markers": f"CAST({count(q.has('h', '(?i)' + p) for p in V.LAYERED_MARKERS)} AS INT)",
        **{f"built_{k}": holds(q, "h", "low", p) for k, (p, _) in enumerate(V.LAYERED_BUILDERS)},
        "suspicious": q.compact(q.array(*(f"CASE WHEN {q.has('h', '(?i)' + p)} THEN '{n}' END" for p, n in V.LAYERED_SUSPICIOUS))),
        "seo_points": "(" + " + ".join(f"CASE WHEN {q.has('h', p)} THEN {n} ELSE 0 END" for p, n in V.LAYERED_SEO) + ")",
        "is_boilerplate": "(" + " OR ".join(q.has("h", "(?i)" + p) for p in V.LAYERED_BOILERPLATE) + ")",
    }


def layered_joined(q) -> dict[str, str]:
    """layered() with the scan's headers, final_url, robots_found and sitemap_found."""
    powered = f"coalesce({missing(header(q, 'x-powered-by'))}, {missing(header(q, 'x-generator'))})"
    hints = q.compact(q.array(
        f"CASE WHEN {powered} IS NOT NULL THEN concat('X-Powered-By: ', {powered}) END", *(f"CASE WHEN built_{k} OR {q.has('final_url', '(?i)' + p)} THEN '{n}' END" for k, (p, n) in enumerate(V.LAYERED_BUILDERS))))
    hosting = "CASE " + " ".join(f"WHEN contains(lower(final_url), '.{s}') THEN '{n}'" for s, n in V.LAYERED_HOSTS) + " END"
    return {
        "generator_meta": "generator_meta", "tech_hints": hints, "n_markers": "n_markers", "suspicious": "suspicious", "free_hosting": hosting, "is_boilerplate": "is_boilerplate",
        "seo_score": "CAST(least(100, seo_points + CASE WHEN robots_found THEN 15 ELSE 0 END + CASE WHEN sitemap_found THEN 15 ELSE 0 END) AS INT)", "robots_found": "coalesce(robots_found, false)", "sitemap_found": "coalesce(sitemap_found, false)",
    }


def layered_scores(q) -> dict[str, str]:
    generator = "lower(coalesce(generator_meta, ''))"
    free = q.size(q.keep("tech_hints", "x", "(" + " OR ".join(f"contains(lower(x), '{b.lower()}')" for b in V.FREE_BUILDERS) + ")"))
    markup = f"50 + CASE WHEN contains({generator}, 'wix') OR contains({generator}, 'squarespace') THEN 10 WHEN contains({generator}, 'ai') OR contains({generator}, 'gpt') THEN 30 ELSE 0 END + 5 * {free} + 15 * n_markers + 10 * {q.size('suspicious')}"
    infra = "50 + CASE WHEN robots_found THEN 0 ELSE 10 END + CASE WHEN sitemap_found THEN 0 ELSE 10 END + CASE WHEN free_hosting IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN seo_score < 30 THEN 15 WHEN seo_score < 50 THEN 10 ELSE 0 END + CASE WHEN is_boilerplate THEN 20 ELSE 0 END"
    return {"generator_meta": "generator_meta", "tech_hints": q.joined("tech_hints", ","), "suspicious": q.joined("suspicious", ","), "n_markers": "CAST(n_markers AS INT)", "free_hosting": "free_hosting", "seo_score": "seo_score",
            "is_boilerplate": "is_boilerplate", "markup": f"CAST(least(100, greatest(0, {markup})) AS INT)", "infrastructure": f"CAST(least(100, greatest(0, {infra})) AS INT)"}


def candidates(q, c: str) -> dict[str, str]:
    """Addresses and numbers of a text, each once, in order."""
    digits = f"length({q.sub('x', '[^0-9]', '')})"
    emails = q.each(q.all(f"coalesce({c}, '')", V.EMAIL, 0), "x", "lower(x)")
    phones = q.each(q.all(f"coalesce({c}, '')", V.PHONE, 0), "x", f"trim({q.sub('x', chr(92) + 's+', ' ')})")
    return {"emails": q.distinct(q.keep(emails, "x", f"NOT {q.has('x', '(?i)' + V.NOBODYS)}")), "phones": q.distinct(q.keep(phones, "x", f"{digits} BETWEEN 7 AND 15"))}


def contacts(q) -> dict[str, str]:
    """Candidates of the home page (t), and its links to networks (h), by network and then in page order."""
    return candidates(q, "t") | {"social": q.distinct(q.concat(*(q.all("coalesce(h, '')", rf"""(?i)href\s*=\s*["'](https?://(?:www\.)?{p}/[^"']+)["']""") for p in V.SOCIAL)))}


def gathered(q) -> dict[str, str]:
    """The home page's candidates, then those of the contact page (emails_c, phones_c)."""
    return {"emails": q.distinct(q.concat("emails", "emails_c")), "phones": q.distinct(q.concat("phones", "phones_c")), "social": "social", "contact_page": "contact_page"}


def networks(q) -> dict[str, str]:
    """Each network's last link, and all others; a link counts for the first network whose word it has."""
    out, others = {}, []
    for name, words in V.NETWORKS:
        own = "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + ")"
        out[name] = q.last(q.keep("social", "x", " AND ".join([own, *(f"NOT {o}" for o in others)])))
        others.append(own)
    out["other"] = q.joined(q.keep("social", "x", " AND ".join(f"NOT {o}" for o in others)), ",")
    return out


def generic_email(q, emails: str, host: str) -> str:
    """Whether no address is of the site's own domain and one is of a provider for everybody."""
    domain = q.first("x", "@([^@]*)")
    custom = q.size(q.keep(emails, "x", f"{domain} <> '' AND ({domain} = {host} OR right({domain}, length({host}) + 1) = concat('.', {host}) OR right({host}, length({domain}) + 1) = concat('.', {domain}))"))
    common = q.size(q.keep(emails, "x", f"{domain} IN ({', '.join(repr(d) for d in V.GENERIC_EMAILS)})"))
    return f"({custom} = 0 AND {common} > 0)"
