"""Rules of risk over the row of signals, its contacts and its likelihood: one table a type.

A rule is a key, its points, a condition and a reason, all expressions of both engines. The rules of contacts
(CONTACT) count for shell companies up to a cap, but report their full points.
"""

from __future__ import annotations

from . import site
from . import values as V

CATEGORIES = {"phishing": "Phishing", "shell_company": "Shell Company", "compliance": "Compliance"}
CONTACT = ("generic_business_email", "no_physical_address", "no_phone_number", "no_social_presence")


def found(*paths: str) -> str:
    """Whether one of the paths was found; found_paths is a list with commas."""
    return "(" + " OR ".join(f"contains(concat(',', found_paths, ','), ',{p},')" for p in paths) + ")"


def rules(q) -> dict[str, list[tuple[str, str, str, str]]]:
    p, s, c = V.PHISHING, V.SHELL, V.COMPLIANCE
    text = q.quoted
    words = lambda *parts: f"concat({', '.join(parts)})"
    number = lambda x: q.string(x)
    external = f"{q.size('external_form_actions')} > 0"
    headers = "(" + " + ".join(f"CASE WHEN {k}_present THEN 0 ELSE 1 END" for k in ("hsts", "csp", "xfo", "xcto")) + ")"
    age, months = "domain_age_days", number("CAST(floor(domain_age_days / CAST(30 AS DOUBLE) + 0.5) AS INT)")
    suspicious = q.size("suspicious_content_patterns")
    first = q.at("suspicious_content_patterns", 0)
    title = "lower(coalesce(html_title, ''))"
    shop = "(payment_keyword_hint OR " + " OR ".join(f"contains({title}, {text(w)})" for w in V.SHOP_WORDS) + ")"
    about = found("/about", "/about-us", "/aboutus", "/pages/about", "/pages/about-us")
    contact = found("/contact", "/contact-us", "/contactus", "/pages/contact", "/pages/contact-us")
    few = "coalesce(homepage_text_word_count < 150, false)"
    rule = lambda weights, key, condition, reason, points=None: (key, str(points or weights[key]), condition, reason)
    tier = lambda key, condition, reason: rule(s, key, condition, reason)
    return {
        "phishing": [
            rule(p, "login_form_with_external_action", f"login_form_present AND {external}", words(text("Login form submits to external domain(s): "), q.joined("external_form_actions", ", "))),
            rule(p, "password_with_external_action", f"NOT login_form_present AND password_input_count > 0 AND {external}", text("Password input with form action to external domain")),
            rule(p, "password_input_present", f"password_input_count > 0 AND NOT {external}", words(text("Password input field detected (count: "), number("password_input_count"), text(")"))),
            rule(p, "cross_domain_redirect", "cross_domain_redirect", text("Site redirects to a different domain")),
            rule(p, "meta_refresh_redirect", "meta_refresh_present", text("Meta refresh redirect detected")),
            rule(p, "js_redirect_hint", "js_redirect_hint", text("JavaScript redirect code detected")),
            rule(p, "mismatch_input_vs_final", "mismatch_input_vs_final_domain", text("Final URL domain differs from input domain")),
            rule(p, "https_missing", "NOT https_ok", text("Site does not use HTTPS")),
            rule(p, "missing_security_headers", f"{headers} > 0", words(text("Missing "), number(headers), text(" security header(s)")), f"least({headers} * {p['missing_security_headers']}, {p['max_missing_headers_penalty']})"),
            rule(p, "eval_atob_in_scripts", "eval_atob_hint", text("eval() or atob() detected in inline scripts")),
            rule(p, "obfuscated_scripts", "obfuscation_hint", text("Very long inline script detected (possible obfuscation)")),
            rule(p, "external_form_action_exists", f"{external} AND NOT login_form_present", text("Form(s) submit to external domain(s)")),
        ],
        "shell_company": [
            tier("domain_age_under_30_days", f"{age} < 30", words(text("Domain is extremely new ("), number(age), text(" days old)"))),
            tier("domain_age_under_90_days", f"{age} >= 30 AND {age} < 90", words(text("Domain is very new ("), number(age), text(" days old)"))),
            tier("domain_age_under_180_days", f"{age} >= 90 AND {age} < 180", words(text("Domain is new ("), months, text(" months old)"))),
            tier("domain_age_under_1_year", f"{age} >= 180 AND {age} < 365", words(text("Domain is less than 1 year old ("), months, text(" months)"))),
            tier("domain_age_under_2_years", f"{age} >= 365 AND {age} < 730", text("Domain is less than 2 years old")),
            tier("ai_generated_high", "ai_score >= 80", words(text("High AI-generated content likelihood (score: "), number("ai_score"), text(")"))),
            tier("ai_generated_high_confident", "ai_score >= 70 AND ai_score < 80 AND ai_confidence >= 60", words(text("AI-generated content detected (score: "), number("ai_score"), text(", confidence: "), number("ai_confidence"), text(")"))),
            tier("ai_generated_moderate", "ai_score >= 60 AND ai_score < 80 AND NOT (ai_score >= 70 AND ai_confidence >= 60)", words(text("Moderate AI-generated content indicators (score: "), number("ai_score"), text(")"))),
            tier("ai_generated_low", "ai_score >= 50 AND ai_score < 60", words(text("Some AI-generated content indicators (score: "), number("ai_score"), text(")"))),
            tier("many_suspicious_patterns", f"ai_score IS NOT NULL AND {suspicious} >= 3", words(text("Multiple suspicious content patterns: "), q.joined(q.slice("suspicious_content_patterns", 2), ", "))),
            tier("some_suspicious_patterns", f"ai_score IS NOT NULL AND {suspicious} BETWEEN 1 AND 2", words(text("Suspicious content patterns detected: "), first)),
            tier("free_hosting_detected", "ai_score IS NOT NULL AND free_hosting IS NOT NULL", words(text("Site hosted on free platform: "), "free_hosting")),
            tier("boilerplate_structure", "ai_score IS NOT NULL AND is_boilerplate", text("Generic boilerplate/template structure detected")),
            tier("poor_seo", "ai_score IS NOT NULL AND seo_score < 30", words(text("Very poor SEO setup (score: "), number("seo_score"), text("/100)"))),
            tier("missing_robots_txt", "ai_score IS NOT NULL AND NOT has_robots_txt", text("Missing robots.txt")),
            tier("missing_sitemap", "ai_score IS NOT NULL AND NOT has_sitemap", text("Missing sitemap")),
            tier("generic_business_email", site.generic_email(q, "emails", "input_host"), text("Business uses generic email provider (Gmail/Outlook/Yahoo)")),
            tier("no_physical_address", f"{q.size('addresses')} = 0", text("No physical address found")),
            tier("no_phone_number", f"{q.size('phones')} = 0", text("No phone number found")),
            tier("no_social_presence", f"{q.size('social')} = 0", text("No social media presence found")),
            tier("no_linkedin", "linkedin IS NULL", text("No LinkedIn presence")),
            tier("site_shell", "NOT is_active AND dns_ok", words(text("Domain exists (DNS OK) but site serves no content (status: "), f"coalesce({number('status_code')}, 'unknown')", text(")"))),
            tier("dns_failure", "NOT dns_ok", text("DNS lookup failed - no A or AAAA records")),
            tier("no_mx_records", "NOT mx_present", text("No MX records - domain cannot receive email")),
            tier("low_word_count", few, words(text("Very sparse homepage content ("), number("homepage_text_word_count"), text(" words)"))),
            tier("missing_contact_and_about", f"NOT {contact} AND NOT {about}", text("No contact or about page found")),
            tier("cross_domain_redirect", "cross_domain_redirect", text("Redirects to different domain")),
            tier("high_urgency_score", "urgency_score >= 3", words(text("Urgency language detected ("), number("urgency_score"), text(" matches)"))),
            tier("high_discount_score", "extreme_discount_score >= 3", words(text("Extreme discount claims detected ("), number("extreme_discount_score"), text(" matches)"))),
            tier("impersonation_hint", "impersonation_hint", text('Impersonation language detected (e.g., "official dealer")')),
        ],
        "compliance": [
            rule(c, "missing_privacy_policy", f"NOT {found('/privacy', '/privacy-policy')} AND NOT verified_privacy", text("No privacy policy page found")),
            rule(c, "missing_terms", f"NOT {found('/terms', '/terms-of-service')} AND NOT verified_terms", text("No terms of service page found")),
            rule(c, "missing_refund_policy", f"{shop} AND NOT {found('/refund', '/returns')} AND NOT verified_refund", text("E-commerce site without refund/returns policy")),
            rule(c, "missing_shipping_info", f"{shop} AND NOT {found('/shipping')}", text("E-commerce site without shipping information")),
            rule(c, "missing_contact", f"NOT {found('/contact')} AND {q.size('emails')} = 0 AND {q.size('phones')} = 0 AND {q.size('addresses')} = 0 AND contact_page IS NULL", text("No contact page found")),
            rule(c, "missing_about", f"NOT {found('/about')}", text("No about page found")),
            rule(c, "payment_keywords_no_policies", f"payment_keyword_hint AND NOT ({found('/privacy', '/privacy-policy', '/terms', '/terms-of-service')} OR verified_privacy OR verified_terms)", text("Payment-related content without privacy/terms policies")),
            rule(c, "no_sitemap", "coalesce(sitemap_url_count, 0) = 0", text("No accessible sitemap found")),
            rule(c, "many_disallows", "disallow_count_for_user_agent_star > 10", words(text("robots.txt blocks many paths ("), number("disallow_count_for_user_agent_star"), text(" disallows)"))),
        ],
    }


def applied(q) -> str:
    """The rules that hold, as an array of structs in the order of the table."""
    flat = [(kind, *rule) for kind, rows in rules(q).items() for rule in rows]
    rows = [q.struct(n=str(n), category=q.quoted(kind), key=q.quoted(key), points=f"CAST({points} AS INT)", hit=f"coalesce({condition}, false)", reason=f"CASE WHEN coalesce({condition}, false) THEN {reason} END")
            for n, (kind, key, points, condition, reason) in enumerate(flat)]
    return q.keep(q.array(*rows), "x", "x.hit")


def scores(q) -> dict[str, str]:
    """By type the points of applied, held to 100."""
    contact = ", ".join(f"'{k}'" for k in CONTACT)
    total = lambda condition: q.sum(q.each(q.keep("applied", "x", condition), "x", "x.points"))
    shell = f"{total(f'x.category = {chr(39)}shell_company{chr(39)} AND x.key NOT IN ({contact})')} + least({V.SHELL['max_contact_penalty']}, {total(f'x.category = {chr(39)}shell_company{chr(39)} AND x.key IN ({contact})')})"
    out = {k: total(f"x.category = '{k}'") for k in CATEGORIES} | {"shell_company": shell}
    return {k: f"CAST(least(100, {x}) AS INT)" for k, x in out.items()}


def confidence() -> str:
    c = V.CONFIDENCE
    page = f"CASE WHEN NOT is_active THEN {c['homepage_fetch_failed']} WHEN NOT coalesce(contains(content_type, 'text/html'), false) THEN {c['non_html_response']} ELSE 0 END"
    return f"CAST(greatest(0, least({c['highest']}, {c['base']} + {page} + CASE WHEN robots_fetched THEN {c['robots_sitemap_checked']} ELSE 0 END + CASE WHEN n_found_paths >= 4 THEN {c['policy_pages_checked']} ELSE 0 END + CASE WHEN homepage_text_word_count < 150 THEN {c['low_word_count']} ELSE 0 END)) AS INT)"


OVERALL = "CAST(floor(CAST(0.6 AS DOUBLE) * greatest(phishing, shell_company, compliance) + CAST(0.4 AS DOUBLE) * ((phishing + shell_company + compliance) / CAST(3 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) AS INT)"
PRIMARY = "CASE WHEN phishing >= shell_company AND phishing >= compliance THEN 'phishing' WHEN shell_company >= compliance THEN 'shell_company' ELSE 'compliance' END"
