"""Fixed values of the rules: word lists, patterns, limits, messages."""

from __future__ import annotations

# URL rules.
BINARY_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".mp4", ".mp3",
    ".zip", ".gz", ".tar", ".woff", ".woff2", ".ttf", ".eot", ".ico",
]
TRACKING_PARAMS = ["fbclid", "gclid", "mc_eid", "_ga", "ref", "source"]
SKIP_HREF_PREFIXES = ["mailto:", "tel:", "javascript:", "data:", "#"]
SKIP_PATH_FRAGMENTS = ["/cdn-cgi/", "/__webpack/", "/static/chunk", "/node_modules/", "/.well-known/"]
PRIORITY_KEYWORDS = [
    "/checkout", "/cart", "/basket", "/payment", "/order",
    "/login", "/signin", "/signup", "/register", "/auth",
    "/contact", "/help", "/support", "/accessibility", "/faq",
    "/search", "/results", "/product", "/item", "/listing",
    "/form", "/apply", "/booking", "/schedule", "/subscribe",
    "/dashboard", "/account", "/profile", "/settings",
]
PRIORITY_BOOST = 0.3
DEFAULT_PRIORITY = 0.5
AGREEMENT_BOOST = 0.2
SHALLOW_BOOST, SHALLOW_DEPTH = 0.1, 2
CRITICAL_TOKENS = {
    "auth": ["/login", "/signin", "/signup", "/register", "/auth"],
    "form": ["/form", "/apply", "/booking", "/schedule", "/subscribe", "/contact"],
    "product": ["/product", "/item", "/listing", "/search", "/results", "/checkout", "/cart"],
}
HOMEPAGES = ["", "/", "/index.html", "/index.htm"]
PAGINATION = r"(?i)/page/[0-9]+|/p/[0-9]+|[?&](?:page|offset|start|p)=[0-9]+"
SEGMENT_UUID = r"(?i)^[a-f0-9]{8}-?[a-f0-9]{4}-?[a-f0-9]{4}-?[a-f0-9]{4}-?[a-f0-9]{12}$|^[a-f0-9]{16,}$"

# Link selection.
INTERACTION_URL_KEYWORDS = [
    "/login", "/signin", "/signup", "/register", "/checkout", "/cart",
    "/contact", "/search", "/account", "/profile", "/settings",
]
INTERACTION_TEXT_KEYWORDS = ["sign in", "log in", "register", "contact", "search", "get started", "book", "buy", "checkout"]
EXCLUDED_SCHEMES = ["mailto:", "tel:", "javascript:", "data:"]
EXCLUDED_EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".css", ".js", ".zip", ".xml"]
PAGED_PATH = r"/page/[0-9]+"
ARCHIVE_PATH = r"/(tag|category|archive)/"
LOW_VALUE_PATH = r"/(tag|archive|search|filter)/"

# Topology.
TOPOLOGY_CAP = 500
STRUCTURAL_SHARE = 0.30
TOPOLOGY_QUOTA = {"single_page": 1, "thin": 5, "deep_uniform": 3, "paginated": 3, "multi_template": 2}
TOPOLOGY_MILESTONES = [1, 10, 25, 50, 100]

# Scan modes.
MODE_ALIASES = {
    "fast": ["fast", "minimal", "light"],
    "deep": ["deep", "standard"],
    "max": ["max", "full", "thorough"],
}
#: default, sitemap and ceiling pages, depth, timeout ms, two stage timeouts, service level s, concurrency
SCAN_PROFILES = {
    "fast": (5, 8, 10, 2, 15000, 12, 4, 35, 5),
    "deep": (15, 25, 30, 4, 30000, 25, 12, 120, 3),
    "max": (40, 60, 75, 6, 60000, 40, 18, 240, 2),
}
TIMEOUT_BOUNDS = {"fast": (8, 10), "deep": (12, 15), "max": (20, 40)}

# Failures.
REASONS = [
    "connectivity_blocked", "browser_navigation_failed", "extraction_failed", "render_timeout", "partial_content",
    "engine_error", "rate_limited", "csp_blocked", "csp_injection_blocked", "bot_wall",
]
REASON_ALIASES = {
    "browser_navigation_failed": "browser_navigation_failed",
    "browser_timeout": "render_timeout",
    "dom_parse_error": "extraction_failed",
    "dns_error": "connectivity_blocked",
    "dns_failure": "connectivity_blocked",
    "name_resolution_failed": "connectivity_blocked",
    "network_error": "connectivity_blocked",
    "script_failure": "csp_injection_blocked",
    "extraction_failure": "extraction_failed",
    "blocked": "bot_wall",
    "blocked_request": "bot_wall",
    "access_denied": "bot_wall",
    "cloudflare_block": "bot_wall",
    "unknown": "engine_error",
}
CAPTCHA_TOKENS = [
    "captcha", "security check", "challenge", "turnstile", "are you human", "are you a robot", "bot protection", "cf-chl",
    "cloudflare", "datadome", "akamai", "access denied", "forbidden", "status code 403", "http status 403",
]
CAPTCHA_HEADERS = ["server", "cf-ray", "x-datadome", "x-akamai-session-info", "x-amz-cf-id"]
CSP_TOKENS = [
    "content security policy", "csp", "refused to execute inline script", "refused to load the script",
    "violates the following content security policy directive",
]
CONNECT_TOKENS = [
    "dns", "getaddrinfo", "name not resolved", "name resolution", "nxdomain", "eai_again",
    "temporary failure in name resolution", "connection reset", "connection refused", "connection aborted",
    "network is unreachable", "server disconnected", "socket", "ssl", "tls", "certificate", "proxy", "connecterror",
    "net::err_connection",
]
NAVIGATION_TOKENS = ["navigation", "page.goto", "execution context", "target closed", "frame was detached", "net::err"]
TIMEOUT_TOKENS = ["timeout", "timed out", "navigation timeout", "render timeout"]
EXTRACTION_TOKENS = ["parse", "parser", "lxml", "beautifulsoup", "dom", "html", "selector", "snapshot", "extraction", "content"]
REASON_MESSAGES = {
    "connectivity_blocked": "Network connectivity failed while reaching the target page.",
    "browser_navigation_failed": "Browser navigation failed before the page could be audited.",
    "extraction_failed": "Rendered DOM extraction failed and only partial analysis could run.",
    "render_timeout": "Rendering exceeded timeout budget and partial data was used.",
    "partial_content": "Only partial page content was available for this scan.",
    "engine_error": "An internal scan engine error occurred.",
    "rate_limited": "The target site rate-limited the scanner (HTTP 429).",
    "csp_blocked": "Content Security Policy prevented full browser probing.",
    "csp_injection_blocked": "Content Security Policy blocked script injection during probing.",
    "bot_wall": "The target site blocked automated traffic or presented a bot challenge.",
}
FAILURE_ACTIONS = {
    "rate_limited": "reduce_concurrency",
    "render_timeout": "reduce_concurrency",
    "bot_wall": "stop_crawl",
    "connectivity_blocked": "stop_crawl",
    "csp_blocked": "disable_browser_engines",
    "csp_injection_blocked": "disable_browser_engines",
    "browser_navigation_failed": "count_failure",
    "extraction_failed": "count_failure",
    "partial_content": "count_failure",
    "engine_error": "count_failure",
}
#: What a crawl does next, by action.
ADAPTIVE_ACTIONS = {"reduce_concurrency": "slow_down", "stop_crawl": "stop", "disable_browser_engines": "static_only", "count_failure": "continue"}
FAILURE_SEVERITY = {
    "bot_wall": 1.0, "connectivity_blocked": 0.9, "browser_navigation_failed": 0.8, "rate_limited": 0.6, "csp_blocked": 0.5,
    "csp_injection_blocked": 0.5, "render_timeout": 0.4, "extraction_failed": 0.3, "partial_content": 0.3, "engine_error": 0.2,
}

# Requests.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/123.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:124.0) Gecko/20100101 Firefox/124.0",
]
REQUEST_HEADERS = {
    "Accept-Language": "en-US,en;q=0.9",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Cache-Control": "no-cache",
    "Pragma": "no-cache",
}
TRACKER_HOSTS = [
    "googletagmanager.com", "google-analytics.com", "doubleclick.net", "googlesyndication.com", "facebook.net",
    "facebook.com", "hotjar.com", "mixpanel.com", "segment.io", "intercom.io",
]
WHITELIST_HOSTS = ["fonts.googleapis.com", "fonts.gstatic.com", "cdn.jsdelivr.net"]
BLOCKED_URL_TOKENS = ["analytics", "collect", "gtm.js", "fbevents", "segment", "mixpanel", "hotjar", "pixel"]
HEAVY_HOSTS = [
    "facebook.", "instagram.", "x.com", "twitter.", "linkedin.", "reddit.", "nytimes.", "pinterest.", "amazon.", "target.",
    "bestbuy.", "etsy.", "bankofamerica.", "chase.", "paypal.", "webmd.", "cdc.", "who.",
]
HEAVY_PATHS = ["/checkout", "/cart", "/basket", "/payment", "/account", "/login", "/signin", "/auth", "/feed", "/timeline"]
MODERATE_PATHS = ["/search", "/product", "/listing", "/results", "/news", "/article"]
PAGE_MULTIPLIERS = {
    "fast": {"simple": 0.6, "moderate": 0.8, "heavy": 1.0},
    "deep": {"simple": 0.7, "moderate": 1.0, "heavy": 1.3},
    "max": {"simple": 0.8, "moderate": 1.1, "heavy": 1.4},
}
IO_MULTIPLIERS = {"simple": 0.65, "moderate": 1.0, "heavy": 1.25}
PAGE_TIMEOUTS = {"fast": (6, 10), "deep": (15, 40), "max": (20, 60)}
NETWORK_TIMEOUT_MS, READY_TIMEOUT_MS = (2500, 22000), (2000, 12000)
FALLBACK_PATHS = ["about", "explore", "features", "pricing"]
LOGIN_URL_TOKENS = ["/login", "/signin", "/auth", "/oauth", "/sso", "/accounts"]
COOKIE_ACCEPT_TOKENS = ["accept all", "accept", "i agree", "ok", "agree", "got it", "allow all", "consent"]
COOKIE_CONTEXT_TOKENS = ["cookie", "consent", "privacy"]

# Sitemaps.
SITEMAP_FALLBACKS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps/sitemap.xml"]
SITEMAP_CAP, SITEMAP_DEPTH = 200, 5

# Advice after a crawl.
ADVICE = {
    "failures": "High failure rate. Check anti-bot settings or proxy health.",
    "low_gain": "Low information gain. Consider more diverse seeds or higher depth.",
    "none": "Continue current strategy.",
}
