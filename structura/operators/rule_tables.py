"""Site-structure rule tables.

The reference states these rules as prose inside its model prompt and never
executes them.  Here each rule is a small table of fixed values; the
operators in :mod:`structura.operators.rules` turn the tables into column
expressions (``CASE`` chains, literal maps) or small DataFrames, so a rule
costs no shuffle on the URL table.  The DuckDB twins are generated from the
same tables.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# V1: path segments that are not pages, with the reason reported.
EXCLUDED_SEGMENTS = {
    "admin": "admin", "wp-admin": "admin", "dashboard": "admin",
    "login": "account", "register": "account", "my-account": "account",
    "search": "search",
    "multilingual-support": "technical_feature", "crm-functionalities": "technical_feature",
    "backend-data": "technical_feature", "analytics": "technical_feature",
    "website-goals": "questionnaire_metadata", "decision-criteria": "questionnaire_metadata",
    "evaluating-factors": "questionnaire_metadata",
    "content-updates": "internal_process", "broken-links": "internal_process",
    "customer-feedback": "internal_process",
    "submit": "form_endpoint", "form-submit": "form_endpoint",
}
PAGINATION_RE = r"(^|/)page/[0-9]+$"            # /blog/page/2 (on the segment path)
LANG_CODE_RE = r"^[a-z]{2}(-[a-z]{2})?$"        # language prefix segment (ISO 639-1 shape)

# V2: listing page -> its detail-page template.
LISTING_DETAIL = [
    ("news", "single-news"), ("blog", "single-post"), ("products", "single-product"),
    ("projects", "single-project"), ("properties", "single-property"),
    ("services", "single-service"), ("events", "single-event"),
    ("team", "single-member"), ("portfolio", "single-work"),
]

# V3: deepest level allowed under the homepage.
MAX_LEVELS = 3

# V4: pages each industry needs.
INDUSTRY_PAGES = {
    "restaurant": ["menu", "reservations", "location", "gallery"],
    "real_estate": ["properties", "properties/for-sale", "properties/for-rent",
                    "properties/single-property", "agents"],
    "law_firm": ["practice-areas", "attorneys", "case-results", "consultation"],
    "medical": ["services", "doctors", "appointments", "insurance"],
    "ecommerce": ["products", "shipping-information", "returns-policy"],
    "agency": ["portfolio", "portfolio/single-project", "services", "clients"],
    "saas": ["features", "pricing", "documentation", "use-cases"],
}

# V5: legal pages required by a site trait.
LEGAL_PAGES = [
    ("collects_data", "privacy-policy"),
    ("ecommerce", "terms-and-conditions"),
    ("eu_audience", "privacy-policy"), ("eu_audience", "cookie-policy"),
    ("professional", "privacy-policy"), ("professional", "disclaimer"),
]

# V6: multilingual approaches; 'parameter' is the default.
ML_APPROACHES = ["subdirectory", "parameter", "subdomain"]
ML_DEFAULT = "parameter"
ML_PARAM = "lang"

# V7-V9: page classes, first match wins.  Matched against the path with a
# leading '/', homepage '/', language prefix removed.  Columns: class,
# pattern, priority, changefreq, lastmod window in days (0 = anchor date).
# Products/services appear under 0.9 and 0.8 in the prose; the higher wins.
PAGE_CLASSES = [
    ("homepage", r"^/$", "1.0", "daily", 0),
    ("legal", r"/(privacy-policy|terms-and-conditions|cookie-policy|disclaimer|terms|cookies)$",
     "0.4", "monthly", 180),
    ("archive", r"/(archive|archives|tag|tags)(/|$)", "0.3", "yearly", 180),
    ("detail_template", r"/single-[^/]+$", "0.5", "monthly", 90),
    ("shop_main", r"^/(products|shop)$", "0.9", "daily", 30),
    ("services_main", r"^/services$", "0.9", "weekly", 30),
    ("conversion", r"^/(contact|pricing)$", "0.9", "monthly", 90),
    ("about", r"^/(about|about-us)$", "0.8", "monthly", 90),
    ("news_listing", r"^/(blog|news)$", "0.7", "daily", 30),
    ("active_listing", r"^/(events|portfolio)$", "0.7", "weekly", 30),
    ("listing", r"^/(projects|properties)$", "0.7", "weekly", 30),
    ("team", r"^/team$", "0.6", "monthly", 90),
    ("subcategory", r"^/(products|services|projects|properties|blog|news|events|portfolio)/[^/]+",
     "0.6", "monthly", 90),
]
DEFAULT_CLASS = ("standard", "0.5", "monthly", 90)
CHANGEFREQ_VALUES = ["always", "hourly", "daily", "weekly", "monthly", "yearly", "never"]

# URL style.
LINT_MAX_DEPTH = 4
LINT_MAX_LENGTH = 100

# Questionnaire vocabulary, token -> (signal, value).
PROFILE_KEYWORDS = {
    # business type
    "restaurant": ("business_type", "restaurant"), "cafe": ("business_type", "restaurant"),
    "menu": ("business_type", "restaurant"),
    "property": ("business_type", "real_estate"), "realestate": ("business_type", "real_estate"),
    "apartment": ("business_type", "real_estate"),
    "lawyer": ("business_type", "law_firm"), "attorney": ("business_type", "law_firm"),
    "law": ("business_type", "law_firm"),
    "clinic": ("business_type", "medical"), "dental": ("business_type", "medical"),
    "doctor": ("business_type", "medical"),
    "shop": ("business_type", "ecommerce"), "store": ("business_type", "ecommerce"),
    "ecommerce": ("business_type", "ecommerce"),
    "agency": ("business_type", "agency"), "studio": ("business_type", "agency"),
    "saas": ("business_type", "saas"), "software": ("business_type", "saas"),
    # dynamic content types
    "blog": ("dynamic", "blog"), "news": ("dynamic", "news"),
    "product": ("dynamic", "products"), "products": ("dynamic", "products"),
    "project": ("dynamic", "projects"), "projects": ("dynamic", "projects"),
    "properties": ("dynamic", "properties"),
    "service": ("dynamic", "services"), "services": ("dynamic", "services"),
    "event": ("dynamic", "events"), "events": ("dynamic", "events"),
    "team": ("dynamic", "team"), "portfolio": ("dynamic", "portfolio"),
    # traits
    "cart": ("trait", "ecommerce"), "checkout": ("trait", "ecommerce"),
    "payment": ("trait", "ecommerce"), "payments": ("trait", "ecommerce"),
    "multilingual": ("trait", "multilingual"), "languages": ("trait", "multilingual"),
    "translation": ("trait", "multilingual"),
    "newsletter": ("trait", "collects_data"), "form": ("trait", "collects_data"),
    "email": ("trait", "collects_data"), "account": ("trait", "collects_data"),
    "gdpr": ("trait", "eu_audience"), "eu": ("trait", "eu_audience"),
    "europe": ("trait", "eu_audience"), "european": ("trait", "eu_audience"),
    "consulting": ("trait", "professional"), "accounting": ("trait", "professional"),
    "legal": ("trait", "professional"),
}
TOKEN_SPLIT_RE = r"[^\p{L}\p{N}]+"
# Pages every generated site has besides the homepage.
BASE_PAGES = ["about", "contact"]
# Words that refuse what follows them; sentence ends; words of a phrase.
NEGATIONS = ["no", "not", "none", "never", "without", "don't", "doesn't", "ne", "nije", "bez"]
SENTENCE_END_RE = r"[.!?;\n]+"
PHRASE_SPLIT_RE = r"[^\p{L}\p{N}.']+"
# Phrases that name an approach to languages.
APPROACH_PHRASES = {"subdirectory": "subdirectory", "subfolder": "subdirectory", "language folder": "subdirectory", "language folders": "subdirectory",
                    "subdomain": "subdomain", "subdomains": "subdomain", "language parameter": "parameter", "url parameter": "parameter"}
# ---------------------------------------------------------------------------

EXCLUDE_REASONS = ["admin", "account", "search", "filter", "pagination", "language_prefix",
                   "form_endpoint", "technical_feature", "questionnaire_metadata", "internal_process"]

# Phrases that name a page: the last segment of every page of the tables above, its words apart, and singular forms of one word.
PAGE_PHRASES = {}
for _page in [*BASE_PAGES, *(a for a, _ in LISTING_DETAIL), *(p for pages in INDUSTRY_PAGES.values() for p in pages if "single-" not in p), *(p for _, p in LEGAL_PAGES)]:
    _words = _page.rsplit("/", 1)[-1].replace("-", " ")
    PAGE_PHRASES.setdefault(_words, _page)
    if _words.endswith("s") and " " not in _words and _words not in ("news", "events"):
        PAGE_PHRASES.setdefault(_words[:-1], _page)
PAGE_PHRASES |= {"about us": "about", "contact us": "contact", "contact page": "contact", "event calendar": "events"}
