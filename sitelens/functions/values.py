"""Fixed values that results must agree on, and nothing else."""

# Tags that are counted.
TAGS = ["div", "span", "p", "a", "img", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "main", "aside", "form", "input", "button", "table"]

# The tag that names a page's generator.
GENERATOR = r"""(?i)<meta[^>]*name\s*=\s*["']generator["'][^>]*content\s*=\s*["']([^"']*)["']"""

# What signals and features look for in markup.
META_REFRESH = r"""(?i)<meta[^>]+http-equiv\s*=\s*["']?refresh"""
PASSWORD_INPUT = r"""(?i)<input[^>]+type\s*=\s*["']?password"""
EMAIL_INPUT = r"""(?i)<input[^>]+type\s*=\s*["']?email"""
SUBMIT_INPUT = r"""(?i)<input[^>]+type\s*=\s*["']?submit"""
FORM_ACTION = r"""(?i)<form[^>]+action\s*=\s*["']?([^"'\s>]+)"""
SCRIPT_SOURCE = r"""(?i)<script[^>]+src\s*=\s*["']([^"']+)["']"""
INLINE_SCRIPT = r"(?i)<script[^>]*>([^<]*)</script>"
EVALUATES = r"\b(?:eval|atob)\s*\("
LINK_HREF = r"""(?i)<a\s+[^>]*href\s*=\s*["']([^"']*)["']"""
COMPARED_LINK = r"""(?i)<a\s+[^>]*href\s*=\s*["'][^"']*["'][^>]*>"""
COMPARED_PASSWORD = r"""(?i)<input[^>]*type\s*=\s*["']password["']"""
BLOCK_TAGS = r"(?i)<(header|main|section|article|aside|footer|nav|div)[^>]*>"
#: Characters of a page in which script redirects are looked for, and of an inline script that is too long.
REDIRECT_WINDOW, LONG_SCRIPT = 50_000, 10_000

# Words of urgency, discounts, payment and impersonation.
URGENCY = r"(?i)\b(urgent|act now|limited time|hurry|expires|last chance|don't miss|only \d+ left|ending soon|order now|buy now|limited offer)\b"
DISCOUNT = r"(?i)\b(\d{2,3}%\s*off|free shipping|clearance|sale|save \d{2,3}%|was \$\d+.*now \$\d+|reduced|markdown|blowout)\b"
PAYMENT = r"(?i)\b(payment|checkout|credit card|debit card|paypal|stripe|visa|mastercard|american express|bitcoin|crypto|wire transfer|bank transfer)\b"
IMPERSONATION = r"(?i)\b(official|authorized|certified|genuine|authentic|verified|trusted)\s*(dealer|seller|retailer|partner|reseller)\b"
JS_REDIRECT = r"(?i)(?:window\.)?location(?:\.href)?\s*=|location\.replace\s*\(|location\.assign\s*\("
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}"

# Currency signs in the order in which they are tried, then codes before and after a number.
CURRENCY_SIGNS = [("R$", "BRL"), ("C$", "CAD"), ("A$", "AUD"), ("HK$", "HKD"), ("S$", "SGD"), ("NZ$", "NZD"), ("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("¥", "JPY"), ("₹", "INR"), ("₱", "PHP"), ("₩", "KRW"), ("₫", "VND"), ("฿", "THB"), ("₴", "UAH")]
CURRENCY_CODES = "SGD USD EUR GBP AUD CAD NZD HKD JPY CNY INR AED SAR MYR THB PHP IDR KRW VND TWD CHF SEK NOK DKK PLN CZK HUF RUB ZAR BRL MXN ARS CLP COP PEN".split()
CURRENCY_SUFFIXES = ["SGD", "USD", "EUR"]



def price_patterns() -> list[tuple[str, str]]:
    """(pattern, currency) in the order in which they are tried; a sign or code before a number, then a code after it."""
    number = r"([\d,]+\.?\d*)"
    before = [(sign.replace("$", r"\$"), code) for sign, code in CURRENCY_SIGNS] + [(code, code) for code in CURRENCY_CODES]
    return [(rf"(?i){mark}\s*{number}", code) for mark, code in before] + [(rf"(?i){number}\s*{code}", code) for code in CURRENCY_SUFFIXES]


# Free hosting suffixes, names and scores; and the shorter list that is looked for anywhere in an address.
FREE_HOSTS = [("onrender.com", "Render", 40), ("vercel.app", "Vercel", 30), ("netlify.app", "Netlify", 30), ("github.io", "GitHub Pages", 25), ("pages.dev", "Cloudflare Pages", 25), ("herokuapp.com", "Heroku", 35), ("railway.app", "Railway", 35), ("fly.dev", "Fly.io", 30), ("surge.sh", "Surge", 35), ("glitch.me", "Glitch", 40), ("replit.app", "Replit", 45), ("web.app", "Firebase", 25), ("firebaseapp.com", "Firebase", 25)]
LAYERED_HOSTS = [("vercel.app", "Vercel"), ("netlify.app", "Netlify"), ("herokuapp.com", "Heroku"), ("github.io", "GitHub Pages"), ("pages.dev", "Cloudflare Pages"), ("firebaseapp.com", "Firebase"), ("web.app", "Firebase")]

# Site builders (pattern, name, kind, score), in the order in which they are tried.
SITE_BUILDERS = [
    (r"""generator["']?\s*[:=]\s*["']?Framer""", "Framer", "builder", 75), ("framer-", "Framer", "builder", 70), (r"""generator["']?\s*[:=]\s*["']?Webflow""", "Webflow", "builder", 65), ("webflow", "Webflow", "builder", 60),
    (r"""generator["']?\s*[:=]\s*["']?Wix""", "Wix", "builder", 60), (r"wix\.com", "Wix", "builder", 55), (r"""generator["']?\s*[:=]\s*["']?Squarespace""", "Squarespace", "builder", 55), ("squarespace", "Squarespace", "builder", 50),
    (r"""generator["']?\s*[:=]\s*["']?Carrd""", "Carrd", "builder", 70), (r"carrd\.co", "Carrd", "builder", 65), (r"""generator["']?\s*[:=]\s*["']?Notion""", "Notion", "builder", 60), (r"super\.so|notion\.site", "Notion Site", "builder", 60),
    ("__next", "Next.js", "framework", 25), ("_next/", "Next.js", "framework", 25), (r"""generator["']?\s*[:=]\s*["']?Next\.js""", "Next.js", "framework", 30), ("gatsby", "Gatsby", "framework", 30), ("nuxt", "Nuxt", "framework", 30),
    ("react", "React", "framework", 20), ("vue", "Vue", "framework", 20), ("svelte", "Svelte", "framework", 25), ("astro", "Astro", "framework", 30),
    (r"""generator["']?\s*[:=]\s*["']?WordPress""", "WordPress", "cms", 20), ("wp-content", "WordPress", "cms", 15), (r"""generator["']?\s*[:=]\s*["']?Drupal""", "Drupal", "cms", 15), (r"""generator["']?\s*[:=]\s*["']?Joomla""", "Joomla", "cms", 15), ("shopify", "Shopify", "cms", 35),
]

# Marks of generated pages (pattern, description, score).
AI_MARKERS = [(r"generated\s*by\s*ai", "Contains 'generated by AI' text", 40), ("ai-generated", "Contains 'AI-generated' marker", 40), (r"created\s*with\s*ai", "Contains 'created with AI' text", 35), (r"<!--\s*AI\s*generated", "AI generated HTML comment", 30), ("chatgpt|gpt-4|claude|anthropic", "References AI model names", 25), (r"lorem\s*ipsum", "Contains placeholder text", 15)]

# Suspicious content (pattern, description, score, least matches), and the most that it adds.
SUSPICIOUS = [
    (r"(?:hahaha|hehe|hihi|lol|wow)[·\-\s]+[a-z]", "Nonsensical product name prefix (e.g., 'Hahaha·')", 35, 1),
    (r"[A-Za-z]+[·•]+[A-Za-z]+\s+(?:version|edition|style|type|model)", "Unusual punctuation in product names", 25, 1),
    (r"curved\s+blade\s+guard|straight\s+tube\s+pants|wide\s+leg\s+version", "Awkward literal translation patterns", 30, 1),
    (r"(?:small|big|large)\s+(?:fragrance|smell)\s+(?:version|type)", "Nonsensical fragrance descriptions", 30, 1),
    (r"\b(?:high\s+quality|best\s+quality|top\s+quality)\s+(?:cheap|low\s+price|discount)", "Suspicious quality + price claims", 25, 1),
    (r"\b(?:factory|warehouse)\s+direct\s+(?:sale|price|shipping)", "Factory direct sale claims", 20, 1),
    (r"\b(?:limited\s+time|flash\s+sale|clearance)\s+(?:\d+%\s+off|\$\d+)", "Aggressive discount language", 15, 1),
    (r"\bvery\s+(?:much\s+)?(?:good|nice|beautiful)\s+(?:quality|product|item)\b", "Broken English quality claims", 20, 1),
    (r"\b(?:welcome\s+to\s+)?(?:our\s+)?(?:shop|store)\s+(?:buy|purchase)\b", "Awkward shopping invitation", 15, 1),
    (r"\bship(?:ping)?\s+(?:from|to)\s+(?:fast|quick|speed)", "Broken shipping description", 20, 1),
    (r"\b(?:asian|china|chinese)\s+size\b", "Suspicious sizing disclaimer", 15, 1),
    (r"\bplease\s+(?:check|see|read)\s+(?:size\s+)?chart\s+(?:carefully|before)", "Excessive sizing warnings", 10, 3),
    (r"\b(?:only|just)\s+\d+\s+(?:left|remaining|pieces?|items?)\s+(?:in\s+stock)?", "Fake scarcity claims", 20, 1),
    (r"\b(?:order|buy)\s+(?:now|today)\s+(?:get|receive)\s+(?:free|gift)", "Fake urgency with gift claims", 20, 1),
    (r"\b(?:men|women|unisex)\s+(?:casual|fashion)\s+(?:streetwear|vintage)\s+(?:loose|slim)\b", "Keyword-stuffed product categories", 25, 1),
    (r"\bthe\s+(?:is|are|was|were)\s+(?:very|so|too)\b", "Grammar error (article misuse)", 15, 2),
    (r"\b(?:it|this|that)\s+(?:is|are)\s+(?:a|an)\s+(?:very|so)\b", "Awkward intensifier usage", 15, 2),
    (r"\b(?:5\s+stars?|excellent|perfect)\s+(?:product|item|quality)\s+(?:fast|quick)\s+(?:shipping|delivery)", "Templated fake review pattern", 25, 1),
    (r"\bgood\s+(?:seller|shop|store)\s+(?:recommend|recommended)\b", "Generic fake review", 20, 1),
    (r"\b(?:suitable|perfect)\s+for\s+(?:daily|everyday)\s+(?:wear|use|wearing)\s+(?:and|or)\s+(?:party|dating|travel)", "Overly broad usage claims", 15, 1),
]
SUSPICIOUS_CAP = 60

# Marks of templates, of which two make a boilerplate page; and the layered list, of which one does.
BOILERPLATE = [
    r"<title[^>]*>(?:My App|Vite App|React App|Next\.js App|Untitled|Home|Welcome)</title>", r'class="[^"]*(?:hero-content|hero-inner|hero-section)[^"]*"',
    r"""<meta[^>]*description[^>]*content=["'](?:Your personal app|Welcome to|A website|My website|Description here)["']""", r"<!--\s*(?:Add your content|Replace with|TODO|FIXME)\s*-->", "Lorem ipsum|dolor sit amet|consectetur adipiscing",
]
LAYERED_BOILERPLATE = [r"this\s*is\s*a\s*placeholder", r"coming\s*soon", r"under\s*construction", r"site\s*is\s*being\s*built", r"website\s*template"]

# Search-engine marks (pattern, points), over the head except the last two; titles that say nothing.
GENERIC_TITLES = r"(?i)^(?:Home|Welcome|Untitled|My App|Vite App|React App)$"
SEO_TITLE, SEO_DESCRIPTION, SEO_SHORT_DESCRIPTION = r"(?i)<title[^>]*>.{10,}</title>", r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["'][^"']{50,}["']""", r"""(?i)<meta[^>]*name=["']description["']"""
SEO_HEAD = [(r"""(?i)<meta[^>]*property=["']og:""", 15), (r"""(?i)<meta[^>]*name=["']twitter:""", 10), (r"""(?i)<link[^>]*rel=["']canonical["']""", 10)]
SEO_PAGE = [(r"""(?i)<script[^>]*type=["']application/ld\+json["']""", 15), ("(?i)<(?:header|main|footer|article|section|nav)[^>]*>", 10)]
LAYERED_SEO = [(r"(?i)<title[^>]*>[^<]+</title>", 15), (r"""(?i)<meta[^>]+name\s*=\s*["']?description["']?""", 15), (r"""(?i)<link[^>]+rel\s*=\s*["']?canonical["']?""", 10), (r"""(?i)<meta[^>]+property\s*=\s*["']?og:""", 10), (r"(?i)application/ld\+json", 20)]
FAVICON = r"""(?i)<link[^>]*rel=["'](?:icon|shortcut icon|apple-touch-icon)["'][^>]*>"""

# The layered reading's builders, marks and suspicious content.
LAYERED_GENERATOR = r"""(?i)<meta[^>]+name\s*=\s*["']?generator["']?[^>]+content\s*=\s*["']([^"']+)["']"""
LAYERED_BUILDERS = [(r"wix\.com|wixsite\.com", "Wix"), ("squarespace", "Squarespace"), ("webflow", "Webflow"), ("framer", "Framer"), ("shopify", "Shopify"), ("wordpress", "WordPress"), (r"ghost\.io", "Ghost"), (r"carrd\.co", "Carrd"), (r"notion\.site", "Notion")]
FREE_BUILDERS = ["Wix", "Squarespace", "Webflow", "Framer", "Carrd", "Notion"]
LAYERED_MARKERS = [r"generated\s*(?:by|with|using)\s*(?:ai|gpt|chatgpt|claude|gemini)", r"lorem\s*ipsum", r"placeholder\s*text", r"\[insert\s*[^\]]+\]", r"\{\{[^}]+\}\}"]
LAYERED_SUSPICIOUS = [(r"100%\s*(?:money\s*back|satisfaction|guaranteed)", "guarantee_claim"), (r"(?:limited|exclusive)\s*(?:time|offer|deal)", "urgency_language"), (r"act\s*(?:now|fast|today)", "urgency_cta"), (r"(?:risk|obligation)\s*free", "risk_free_claim")]

# Social networks whose links are gathered, and words by which they are told apart.
SOCIAL = [r"(?:facebook|fb)\.com", r"twitter\.com", r"x\.com", r"linkedin\.com", r"instagram\.com", r"youtube\.com"]
NETWORKS = [("linkedin", ["linkedin.com"]), ("twitter", ["twitter.com", "x.com"]), ("facebook", ["facebook.com", "fb.com"]), ("instagram", ["instagram.com"])]
GENERIC_EMAILS = "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com ymail.com aol.com icloud.com me.com protonmail.com proton.me mail.com email.com zoho.com".split()

# Address words of contact pages in sitemaps, and the paths tried for contact pages.
CONTACT_ADDRESS = "(?i)contact|get-in-touch|reach-us|support|help"

# Policy words in anchors, in addresses and in texts, by type.
POLICY_ANCHORS = [
    ("privacy", r"privacy\s*(policy)?|data\s*protect|cookie\s*policy|gdpr|privacidade|política\s*de\s*privacidade|política\s*privacidade|privacidad|política\s*de\s*privacidad|confidentialité|politique\s*de\s*confidentialité|datenschutz|politica\s*sulla\s*privacy"),
    ("refund", r"refund\s*(policy|&\s*returns?)?|returns?\s*(policy|&\s*(refund|exchange))|return\s*(policy|&\s*exchange)|cancellation\s*policy|money\s*back|exchange\s*(policy|&\s*returns?)|devolução|devoluções|reembolso|troca|política\s*de\s*devolução|política\s*de\s*reembolso|devolución|política\s*de\s*devolución|cambio|remboursement|politique\s*de\s*retour|échange|rückgabe|erstattung|umtausch|rimborso|reso|cambio"),
    ("terms", r"terms?\s*(of\s*service|and\s*conditions|of\s*use|\s*&\s*conditions)?|t\s*&\s*c|legal\s*terms|termos\s*de\s*(uso|serviço)|termos\s*e\s*condições|términos\s*de\s*uso|términos\s*y\s*condiciones|conditions\s*générales|conditions\s*d'utilisation|nutzungsbedingungen|agb|termini\s*di\s*servizio|condizioni\s*generali"),
]
POLICY_HREFS = [
    ("privacy", r"/privacy|/privacy-policy|/privacypolicy|/policies/privacy|/site-policy/privacy|/politica-de-privacidade|/privacidade|/politique-de-confidentialite|/datenschutz"),
    ("refund", r"/refund(?:-policy|s?\z|/)|/returns?-policy|/return-policy|/return-exchange|/shipping-returns|/policies/refund|/exchange-policy|/pages/refund|/pages/return|/devolucao|/devolução|/reembolso|/politica-de-devolucao|/devolucion|/reembolso|/remboursement|/politique-de-retour|/rückgabe|/erstattung|/rimborso"),
    ("terms", r"/terms|/terms-of-service|/terms-and-conditions|/termsconditions|/policies/terms|/tos(?:\z|/)|/legal(?:\z|/terms)|/termos-de-uso|/termos|/termos-e-condicoes|/terminos-de-uso|/terminos|/conditions-generales|/nutzungsbedingungen|/agb|/termini"),
]
POLICY_TEXTS = [
    ("privacy", r"privacy\s*policy|personal\s*data|data\s*protection|gdpr|cookie\s*policy|information\s*we\s*collect|privacidade|dados\s*pessoais|proteção\s*de\s*dados|privacidad|datos\s*personales|confidentialité|données\s*personnelles|datenschutz|personenbezogene\s*daten"),
    ("refund", r"refund\s*policy|return\s*policy|cancellation\s*policy|money\s*back\s*guarantee|exchange\s*policy|eligible\s*for\s*refund|return\s*an?\s*item|devolução|reembolso|troca|direito\s*de\s*devolução|devolución|derecho\s*de\s*devolución|remboursement|droit\s*de\s*retour|rückgabe|erstattung|rimborso|diritto\s*di\s*reso"),
    ("terms", r"terms\s*(of\s*service|and\s*conditions|of\s*use)|user\s*agreement|acceptable\s*use|binding\s*agreement|termos\s*de\s*uso|termos\s*de\s*serviço|acordo\s*do\s*usuário|términos\s*de\s*uso|acuerdo\s*de\s*usuario|conditions\s*générales|accord\s*d'utilisateur|nutzungsbedingungen|nutzervereinbarung|termini\s*di\s*servizio|accordo\s*utente"),
]
POLICY_PATH = "policy|privacy|refund|return|terms|legal|tos|exchange|conditions"

# The first common paths of each policy, which are all that is tried, and marks of challenge pages there.
COMMON_PATHS = {"privacy": ["/privacy", "/privacy-policy", "/privacypolicy"], "refund": ["/refund", "/refund-policy", "/returns"], "terms": ["/terms", "/terms-of-service", "/terms-and-conditions"]}
POLICY_CHALLENGES = ["cloudflare", r"attention\s*required", r"just\s*a\s*moment", r"checking\s*your\s*browser", r"security\s*check", r"ray\s*id", r"please\s*verify\s*you\s*are\s*human", r"ddos\s*protection", r"access\s*denied", "blocked"]

# Titles that are buttons or badges.
NO_TITLES = [r"^save\s+\d+%?\z", r"^\d+%\s*off\z", r"^-\d+%\z", r"^sale\z", r"^new\z", r"^hot\z", r"^best\s*seller\z", r"^sold\s*out\z", r"^out\s*of\s*stock\z", r"^in\s*stock\z", r"^add\s*to\s*cart\z", r"^buy\s*now\z", r"^shop\s*now\z",
             r"^view\s*(more|all|details)\z", r"^see\s*(more|all|details)\z", r"^learn\s*more\z", r"^quick\s*view\z", r"^free\s*shipping\z", r"^track\s*your\s*order\z", r"^return.*exchange\z"]

# Words of a shop in titles.
SHOP_WORDS = ["checkout", "cart", "buy now", "add to cart", "shop now", "order now", "payment", "price", "$", "€", "£"]

# Points of the rules, and caps.
PHISHING = {"login_form_with_external_action": 30, "password_with_external_action": 25, "password_input_present": 12, "cross_domain_redirect": 15, "meta_refresh_redirect": 10, "js_redirect_hint": 10, "mismatch_input_vs_final": 15,
            "https_missing": 8, "missing_security_headers": 5, "max_missing_headers_penalty": 20, "eval_atob_in_scripts": 5, "obfuscated_scripts": 5, "external_form_action_exists": 8}
SHELL = {"domain_age_under_30_days": 30, "ai_generated_high": 35, "ai_generated_high_confident": 28, "many_suspicious_patterns": 25, "site_shell": 25, "dns_failure": 25, "domain_age_under_90_days": 18, "domain_age_under_180_days": 12,
         "domain_age_under_1_year": 8, "ai_generated_moderate": 15, "generic_business_email": 15, "no_physical_address": 12, "no_phone_number": 10, "no_social_presence": 10, "free_hosting_detected": 12, "boilerplate_structure": 10,
         "missing_contact_and_about": 12, "cross_domain_redirect": 12, "some_suspicious_patterns": 12, "domain_age_under_2_years": 5, "ai_generated_low": 6, "no_mx_records": 5, "low_word_count": 4, "no_linkedin": 4, "poor_seo": 4,
         "missing_sitemap": 3, "missing_robots_txt": 3, "high_urgency_score": 5, "high_discount_score": 5, "impersonation_hint": 6, "max_contact_penalty": 25}
COMPLIANCE = {"missing_privacy_policy": 18, "missing_terms": 15, "missing_refund_policy": 12, "missing_shipping_info": 8, "missing_contact": 10, "missing_about": 5, "payment_keywords_no_policies": 15, "no_sitemap": 3, "many_disallows": 4}
CONFIDENCE = {"base": 70, "robots_sitemap_checked": 10, "policy_pages_checked": 5, "homepage_fetch_failed": -30, "non_html_response": -30, "low_word_count": -15, "highest": 90}

# Marks of challenge pages in titles and bodies, in the order in which they are tried, and case-sensitive marks of fetched pages.
CHALLENGE_TITLES = ["attention required", "cloudflare", "just a moment", "please wait", "checking your browser", "ddos protection", "access denied", "security check"]
CHALLENGE_BODIES = ["verify you are human", "checking your browser", "ray id", "please enable javascript", "enable cookies", "complete the security check", "prove you are not a robot", "captcha"]
CHALLENGE_MARKS = ["Just a moment...", "_cf_chl_opt", "challenge-platform"]
WAITING_MARKS = ["Just a moment", "Checking your browser", "cf-browser-verification", "challenge-platform", "_cf_chl_opt", "Attention Required"]

# Marks of pages that scripts draw, and of content behind a click.
SCRIPTED = [r"__NEXT_DATA__|_next\/static|react-root", r"__VUE_|vue-app|nuxt", "ng-app|angular|ng-version", "data-reactroot|data-v-|ng-binding", 'lazy-load|data-src|loading="lazy"', 'aria-expanded="false"|data-toggle="collapse"|accordion']
EXPANDABLE = 'aria-expanded="false"|data-toggle="collapse"|accordion|collapsible'

# Marks of missing pages and of contact pages.
MISSING_PAGE = [r"<title[^>]*>.*404.*<\/title>", r"<title[^>]*>.*not\s*found.*<\/title>", r"<title[^>]*>.*page\s*not\s*found.*<\/title>", 'rel="canonical"[^>]*404', r"sorry[!,]?\s*(we\s*)?(couldn'?t|could\s*not)\s*find",
                r"page\s*(you\s*)?(were\s*)?(looking\s*for|requested)\s*(was\s*)?(not\s*found|doesn'?t\s*exist|couldn'?t\s*be\s*found)"]
CONTACT_MARKS = [r"contact\s*(us|information|details)", r"get\s*in\s*touch", r"reach\s*(us|out)", r"customer\s*(service|support)\s*(hotline|number|phone)?", "hotline|helpline", r"call\s*(us|our)", r"email\s*(us|our)",
                 r"send\s*(us\s*)?(a\s*)?message", 'href="tel:', 'href="mailto:', r"phone\s*number", r"business\s*hours", r"operating\s*hours"]

# Titles of parked sites, addresses that are nobody's, and headers of interest.
PARKED = ["parked", "coming soon", "under construction", "domain for sale", "this domain", "buy this domain", "placeholder", "website coming", "site under development", "future home of", "nothing here yet", "page not found", "default page", "congratulations.*new website"]
NOBODYS = r"@example\.|@test\.|@localhost|noreply@|no-reply@|@sentry\.|@wixpress\."
SECURITY_HEADERS = {"hsts": "strict-transport-security", "csp": "content-security-policy", "xfo": "x-frame-options", "xcto": "x-content-type-options", "referrer": "referrer-policy"}

# Paths of products, and paths that are never one.
PRODUCT_PATHS = [r"\/products?\/", r"\/p\/", r"\/item\/", r"\/shop\/", r"\/sku\/", r"\/catalog\/", r"\/goods\/", r"\/merchandise\/", r"\/buy\/", r"\/store\/.*?\/\d+", r"\/dp\/", r"\/pd\/", r"\/listing\/", r"^\/[a-z0-9]+-[a-z0-9]+-[a-z0-9]+-[a-z0-9]+(-[a-z0-9]+)*\/?$"]
NEVER_PRODUCT = [r"^\/$", r"^\/shop\/?$", r"^\/store\/?$", r"\/blog\/", r"\/article\/", r"\/news\/", r"\/post\/", r"\/cart", r"\/checkout", r"\/account", r"\/login", r"\/register", r"\/signup", r"\/signin", r"\/contact", r"\/about", r"\/faq", r"\/help", r"\/support",
                 r"\/privacy", r"\/terms", r"\/policy", r"\/shipping", r"\/returns", r"\/wishlist", r"\/favorites", r"\/search", r"^\/category\/?$", r"^\/categories\/?$", r"\/product-category\/", r"\/collections?\/[^\/]+\/?$", r"\/collection\/[^\/]+\/?$", r"\/pages?\/"]

# Paths at which policies and contacts are looked for, in order.
PROBED_PATHS = ["/privacy", "/privacy-policy", "/terms", "/terms-of-service", "/refund", "/returns", "/shipping", "/contact", "/contact-us", "/contactus", "/pages/contact", "/pages/contact-us", "/about", "/about-us", "/aboutus", "/pages/about", "/pages/about-us"]

# Points that failures take from a comparison's confidence, and its limits.
COMPARISON = {"start": 80, "robots": 80, "challenge": 70, "non_html": 70, "other": 50, "few_words": 20, "no_text": 30, "highest": 90}
FEW_WORDS = 150

# Weights of a comparison, and what it says by score (least score, text), the last for all below.
TEXT_WEIGHT, DOM_WEIGHT = 0.65, 0.35
TEXT_REASONS = [(70, "Homepage text content is semantically similar"), (50, "Homepage text shows moderate semantic overlap"), (30, "Homepage text shows limited semantic similarity"), (None, "Homepage text content covers different topics")]
DOM_REASONS = [(70, "HTML structure and element distribution are similar"), (50, "HTML structure shows moderate similarity"), (30, "HTML structure shows some common patterns"), (None, "HTML structure differs significantly")]
HEADING_REASONS = [(0.5, "Similar section headings/H1-H2 patterns detected"), (0.2, "Some shared heading patterns between pages"), (None, "Different heading structure and section organization")]
ELEMENT_REASONS = [(2, "Similar distribution of forms, buttons, and links"), (5, "Moderate differences in interactive element counts"), (None, "Different layout structure (forms/buttons/links vary)")]
CONFIDENCE_REASONS = [(30, "Low confidence: page blocked, minimal text, or non-HTML content detected"), (50, "Moderate confidence: some data quality limitations")]
NO_TEXT_REASON = "Text content unavailable for one or both pages"
OVERALL_REASONS = [(80, "Overall high similarity suggests potential clone or template reuse"), (60, "Moderate overall similarity - possibly same industry or framework"), (None, "Low overall similarity indicates distinct websites")]

# Characters of html and of text that a comparison stores, and a scan.
COMPARED_HTML, COMPARED_TEXT, STORED_HTML, STORED_TEXT = 100_000, 16_000, 20_480, 8_192

# registries' servers by top-level domain, in order; None where there is none; and the one for all others.
RDAP_SERVERS = {
    "com": "https://rdap.verisign.com/com/v1/", "net": "https://rdap.verisign.com/net/v1/", "org": "https://rdap.publicinterestregistry.org/rdap/", "info": "https://rdap.afilias.net/rdap/info/", "biz": "https://rdap.nic.biz/",
    "name": "https://rdap.verisign.com/name/v1/", "pro": "https://rdap.afilias.net/rdap/pro/", "shop": "https://rdap.gmoregistry.net/rdap/", "store": "https://rdap.centralnic.com/store/", "online": "https://rdap.centralnic.com/online/",
    "site": "https://rdap.centralnic.com/site/", "xyz": "https://rdap.centralnic.com/xyz/", "club": "https://rdap.nic.club/", "app": "https://rdap.nic.google/", "dev": "https://rdap.nic.google/", "uk": "https://rdap.nominet.uk/uk/",
    "ca": "https://rdap.ca.fury.ca/rdap/", "de": "https://rdap.denic.de/", "nl": "https://rdap.sidn.nl/", "eu": "https://rdap.eurid.eu/", "io": None, "co": None, "au": None, "nz": None, "cn": None, "ru": None, "sg": None, "my": None, "id": None,
    "th": None, "ph": None, "vn": None, "in": None, "hk": None, "tw": None, "kr": None, "jp": None,
}
RDAP_ELSEWHERE = "https://rdap.org/"

# Dates and registrars in registries' texts, in the order in which they are tried.
_STAMP, _DAY, _SLASHED, _DOTTED, _SHORT = r"(\d{4}-\d{2}-\d{2}T[\d:]+Z?)", r"(\d{4}-\d{2}-\d{2})", r"(\d{4}/\d{2}/\d{2})", r"(\d{2}\.\d{2}\.\d{4})", r"(\d{1,2}-[A-Za-z]{3}-\d{4})"
CREATED = [
    rf"Creation Date:\s*{_STAMP}", rf"Created Date:\s*{_STAMP}", rf"Registration Date:\s*{_STAMP}", rf"Creation Date:\s*{_DAY}", rf"Created Date:\s*{_DAY}", rf"Created:\s*{_DAY}", rf"Registration Date:\s*{_DAY}", rf"Registered:\s*{_DAY}",
    rf"Registered on:\s*{_DAY}", rf"Registered on:\s*{_SHORT}", rf"Created:\s*{_SHORT}", rf"Creation Date:\s*{_SLASHED}", rf"Created:\s*{_SLASHED}", rf"\[Created on\]\s*{_SLASHED}", rf"created:\s*{_DOTTED}", rf"Creation Date:\s*{_DOTTED}",
    r"Creation Date:\s*([A-Za-z]+ \d{1,2},? \d{4})", r"Created:\s*(\d{1,2} [A-Za-z]+ \d{4})", r"Registered on:\s*(\d{1,2} [A-Za-z]+ \d{4})", rf"domain_dateregistered:\s*{_DAY}", rf"Registration Time:\s*{_DAY}",
]
EXPIRES = [
    rf"Registry Expiry Date:\s*{_STAMP}", rf"Expiry Date:\s*{_STAMP}", rf"Expiration Date:\s*{_STAMP}", rf"Registry Expiry Date:\s*{_DAY}", rf"Expiry Date:\s*{_DAY}", rf"Expiration Date:\s*{_DAY}", rf"Expires on:\s*{_SHORT}", rf"Expiry:\s*{_SHORT}",
    rf"\[Expires on\]\s*{_SLASHED}", rf"paid-till:\s*{_DAY}", rf"Renewal Date:\s*{_DAY}",
]
REGISTRARS = [r"Registrar:\s*(.+)", r"Sponsoring Registrar:\s*(.+)", r"registrar:\s*(.+)", r"Registrar Name:\s*(.+)"]
MONTHS = "january february march april may june july august september october november december".split()
NO_DATES, NO_REGISTRATION = "Could not parse dates from WHOIS output", "Could not get registration date from WHOIS"
