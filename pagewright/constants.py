"""Fixed values that results depend on: selector lists, phrase patterns, codes and limits."""

# Elements removed outright unless they hold preserved content.
REMOVED_SELECTORS = (
    "script",
    "style",
    "noscript",
    "template",
    'link[rel="preload"]',
    'link[rel="prefetch"]',
    'link[rel="dns-prefetch"]',
    'iframe[src*="doubleclick.net"]',
    'iframe[src*="googlesyndication.com"]',
    'iframe[src*="taboola.com"]',
    'iframe[src*="outbrain.com"]',
    'iframe[src*="adservice"]',
    '[id="ads"]',
    '[class="ads"]',
    '[class*=" ad-"]',
    '[class^="ad-"]',
    '[id^="ad-"]',
    '[id*=" ad-"]',
    '[class*="sponsored"]',
    '[id*="sponsored"]',
    '[data-testid*="ad"]',
    '[aria-label*="advertisement" i]',
    '[role="complementary"]',
    "[data-nosnippet]",
    ".advertisement",
    ".ad-container",
    ".adsbox",
    ".ad-slot",
    ".cookie-banner",
    ".cookie-consent",
    ".consent-banner",
    ".gdpr-banner",
    '[id*="cookie"]',
    '[class*="cookie"]',
    '[id*="consent"]',
    '[class*="consent"]',
    "nav:not(article nav):not(main nav)",
    "header:not(article header):not(main header)",
    "footer:not(article footer):not(main footer)",
    '[role="navigation"]:not(article [role="navigation"]):not(main [role="navigation"])',
    '[class*="navbar"]',
    '[id*="navbar"]',
    '[class*="breadcrumb"]',
    '[aria-label*="breadcrumb" i]',
    '[class*="sidebar"]',
    '[id*="sidebar"]',
    '[class*="side-bar"]',
    '[id*="side-bar"]',
    '[data-testid*="sidebar"]',
    '[class*="social"]',
    '[id*="social"]',
    '[class*="share"]',
    '[id*="share"]',
    '[class*="newsletter"]',
    '[id*="newsletter"]',
    '[class*="subscribe"]',
    '[id*="subscribe"]',
    '[class*="related"]',
    '[id*="related"]',
    '[class*="recommended"]',
    '[id*="recommended"]',
    '[class*="comment"]',
    '[id*="comment"]',
    "#comments",
    ".comments",
    '[class*="disqus"]',
    '[id*="disqus"]',
    '[class*="modal"]',
    '[id*="modal"]',
    '[class*="popup"]',
    '[id*="popup"]',
    '[class*="overlay"]',
    '[id*="overlay"]',
    '[class*="paywall"]',
    '[id*="paywall"]',
    '[class*="signup"]',
    '[id*="signup"]',
    '[class*="banner"]',
    '[id*="banner"]',
    '[class*="promo"]',
    '[id*="promo"]',
    '[class*="widget"]',
    '[id*="widget"]',
    '[class*="outbrain"]',
    '[id*="outbrain"]',
    '[class*="taboola"]',
    '[id*="taboola"]',
    '[class*="pagination"]',
    '[id*="pagination"]',
    '[class*="pager"]',
    '[id*="pager"]',
    '[role="navigation"][aria-label*="pagination" i]',
    '[class*="page-nav"]',
    '[class*="load-more"]',
    '[id*="load-more"]',
    "[hidden]",
    "[inert]",
    '[aria-hidden="true"]',
    '[style*="display:none"]',
    '[style*="visibility:hidden"]',
)

# Substrings of class and id that mark an element as noise.
REMOVED_TOKENS = (
    "advert", "adslot", "ad-slot", "adunit", "ad-unit", "adwrapper", "ad-wrapper", "adsense", "sponsor", "promoted", "promo-", "-promo",
    "cookie", "consent", "gdpr", "eu-banner", "subscribe", "newsletter", "mailing", "signup", "sign-up", "register", "account-wall", "paywall", "metered",
    "sidebar", "side-bar", "rail", "left-rail", "right-rail", "footer-", "-footer", "site-footer", "page-footer", "header-", "-header", "site-header",
    "global-nav", "navigation", "nav-", "breadcrumb", "related", "recommended", "popular-post", "trending", "comment", "discussion", "reply", "share", "social",
    "follow-us", "author-box", "bio-box", "widget", "module-", "carousel", "slider", "modal", "popup", "overlay", "lightbox", "toast", "notification",
    "interstitial", "tracking", "analytics", "pixel", "pagination", "pager", "page-nav", "load-more", "show-more",
)

# Content that makes an element and all its ancestors immune to removal.
PRESERVED_SELECTORS = (
    "article", "main", '[role="main"]', '[itemprop="articleBody"]', ".post-content", ".entry-content", ".article-content", ".content-body", ".story-body", ".article-body", ".prose",
    "img", "picture", "source", "figure", "figcaption", "pre", "code", "table", "thead", "tbody", "tr", "td", "th", "blockquote", "canvas", "math", "video", "audio",
    'iframe[src*="player.vimeo.com"]', 'iframe[src*="youtube.com"]', 'iframe[src*="youtu.be"]', 'iframe[src*="youtube-nocookie.com"]', 'iframe[src*="vimeo.com"]',
    'iframe[src*="archive.org"]', 'iframe[src*="wikimedia.org"]', 'iframe[title*="video" i]', 'iframe[role="img"]',
    'svg[role="img"]', "svg[aria-label]", "svg[aria-labelledby]", "details", "summary",
)

# Boilerplate phrases, each bounded by ASCII word boundaries, case-insensitive.
BOILERPLATE = (
    "all rights reserved",
    "copyright",
    "privacy policy",
    "terms of (service|use)",
    "cookie policy",
    "manage (consent|preferences)",
    "subscribe( now)?",
    "sign up (for|to)",
    "join our newsletter",
    "newsletter",
    "follow us",
    "share (this|article|post)",
    "share on",
    "read more",
    "related (articles|posts|content)",
    "recommended (for you|articles|stories)",
    "most (popular|read)",
    "advertisement",
    "sponsored",
    "promoted",
    "click here",
    "open in (new tab|app)",
    "download our app",
    "back to top",
    "leave a comment",
    "comments?",
    "accept (all )?cookies",
    "do not sell my personal information",
    "this site uses cookies",
    "contact us",
    "more stories",
    "more coverage",
    "(previous|next)[ \\t\\n\\r\\f]*page",
    "page [0-9]+ of [0-9]+",
    "load more",
    "show more",
    "skip to",
    "top stories",
    "trending now",
    "editor'?s picks?",
)

# Noise patterns of the audit, without word boundaries, case-insensitive but for the last one's sign.
NOISE = (
    r"cookie\s*(policy|consent|settings|preferences)",
    r"accept\s*(all\s*)?cookies",
    r"subscribe\s*(now|today|to\s*(our|the))",
    r"sign\s*up\s*(for|to)",
    r"newsletter",
    r"privacy\s*policy",
    r"terms\s*(of\s*service|of\s*use|\s*&\s*conditions)",
    r"all\s*rights\s*reserved",
    r"advertisement|sponsored\s*content",
    r"follow\s*us\s*(on|at)",
    r"share\s*(this|on)\s*(twitter|x|facebook|linkedin)",
    r"read\s*more\s*:",
    r"related\s*(articles?|stories|posts)",
    r"recommended\s*(for\s*you|stories)",
    r"most\s*(popular|read|viewed)",
    r"©\s*\d{4}",
    r"click\s*here",
    r"skip\s*to\s*(main\s*)?content",
    r"back\s*to\s*top",
    r"log\s*in|sign\s*in",
    r"create\s*(an?\s*)?account",
)

# Hosts that may not be fetched, matched on the host in lower case.
PRIVATE_HOSTS = (r"^127\.", r"^10\.", r"^172\.(1[6-9]|2[0-9]|3[01])\.", r"^192\.168\.", r"^169\.254\.", r"^0\.", r"^::1$", r"^fc00:", r"^fd", r"^fe80:", r"^localhost$")

# Tracking keys of a query string.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid")

# Paths of the search engine's own pages, and text that tells a blocked results page.
ENGINE_PATHS = ("/search", "/preferences", "/advanced_search", "/setprefs", "/sorry", "/policies")
BLOCKED_TEXT = ("unusual traffic", "not a robot", "automated queries", "our systems have detected", "complete the captcha", "verify you are human", "recaptcha")
AD_BADGES = ("ad", "ads", "sponsored")

# Error codes and warnings.
ERROR_CODES = ("INVALID_URL", "LOAD_TIMEOUT", "NAVIGATION_FAILED", "READABILITY_EMPTY", "SERP_PARSE_FAILED", "SERP_BLOCKED", "SERP_NO_RESULTS", "STDIO_DISCONNECTED", "INTERNAL_ERROR")
WARNINGS = ("READABILITY_UNCERTAIN", "READABILITY_FAILED", "BOILERPLATE_REMOVED", "LINK_DENSE_BLOCKS_REMOVED", "READABILITY_EMPTY")
LOG_LEVELS = ("debug", "info", "warn", "error")

# Tags that stand as blocks in plain text, attributes kept in cleaned markup, and tags that pass through to their children in markdown.
TEXT_BLOCKS = ("p", "div", "section", "article", "aside", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "table", "tr", "dl", "dt", "dd", "figure", "figcaption")
KEPT_ATTRIBUTES = ("src", "href", "alt", "title", "colspan", "rowspan", "headers")
PASS_THROUGH = ("div", "section", "article", "main", "aside", "header", "footer", "figure", "figcaption", "details", "summary", "nav", "span", "mark", "time", "address", "hgroup", "search", "dialog")

# Score tables (from length on, points) and label thresholds.
LENGTH_POINTS = ((5000, 40), (2000, 30), (1000, 20), (300, 10), (50, 5))
LABELS = ((85, "excellent"), (70, "good"), (50, "fair"), (30, "poor"))
