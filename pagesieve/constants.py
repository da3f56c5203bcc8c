"""Fixed values. Results depend on them, so they are stated plainly and never derived."""

# --- fixed values: signal phrases, in report order -------------------------------------
ACCESS_RESTRICTION_SIGNALS = [
    "please log in",
    "please sign in",
    "sign in to continue",
    "sign in to view",
    "log in to continue",
    "log in to view",
    "create an account",
    "you don't have permission",
    "you do not have permission",
    "access denied",
    "access restricted",
    "subscription required",
    "subscribe to read",
    "subscribe to continue",
    "members only",
    "premium content",
    "unlock this article",
    "verify you are human",
    "complete the captcha",
    "prove you're not a robot",
    "enable cookies",
    "cookies are required",
    "403 forbidden",
    "401 unauthorized",
    "payment required",
    "upgrade to access",
    "join to unlock",
    "register to view",
    "login required",
    "authentication required",
]
PAYWALL_SIGNALS = [
    "subscribe now",
    "start your free trial",
    "limited articles remaining",
    "you've reached your limit",
    "become a member",
    "premium subscriber",
    "exclusive content",
    "paywall",
    "meter limit",
]
JS_WALL_SIGNALS = [
    "javascript is disabled",
    "javascript must be enabled",
    "enable javascript",
    "please enable javascript",
    "enhanced tracking protection",
]
SPA_MARKERS = [
    '<div id="root">',
    '<div id="app">',
    '<div id="__next">',
    '<div id="gatsby-focus-wrapper">',
    "window.__next_data__",
    "ng-version=",
    "data-reactroot",
]

# --- fixed values: host lists -----------------------------------------------------------
TWITTER_HOSTS = ["twitter.com", "x.com", "www.twitter.com", "www.x.com"]
MEDIUM_HOSTS = [
    "medium.com",
    "towardsdatascience.com",
    "betterprogramming.pub",
    "levelup.gitconnected.com",
    "javascript.plainenglish.io",
    "uxdesign.cc",
    "hackernoon.com",
    "codeburst.io",
    "itnext.io",
    "proandroiddev.com",
    "infosecwriteups.com",
]
JS_HOSTS = [
    "x.com",
    "twitter.com",
    "www.x.com",
    "www.twitter.com",
    "instagram.com",
    "www.instagram.com",
    "facebook.com",
    "www.facebook.com",
    "linkedin.com",
    "www.linkedin.com",
    "tiktok.com",
    "www.tiktok.com",
    "reddit.com",
    "www.reddit.com",
    "notion.so",
    "www.notion.so",
    "figma.com",
    "www.figma.com",
]

# --- fixed values: noise selectors and dropped tags ---------------------------------------
NOISE_SELECTORS_LONG = [
    ".nav", ".navbar", ".menu", ".sidebar", ".footer", ".header",
    "#nav", "#header", "#footer", ".topbar", ".navigation",
    ".ad-container", ".social-share", ".cookie-banner", ".modal",
]
NOISE_SELECTORS_SHORT = [".nav", ".navbar", ".footer", ".header", ".ad-container"]
NOISE_TAGS_LONG = ["nav", "header", "footer", "aside", "form", "svg", "noscript", "script", "style"]
NOISE_TAGS_SHORT = ["nav", "header", "footer", "aside", "form", "svg", "noscript"]
MARKDOWN_DROP_TAGS = ["script", "style", "svg", "noscript", "meta", "head"]
STRIPPED_DROP_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "svg", "noscript"]
ARTICLE_DROP_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "noscript"]

# --- fixed values: thresholds and limits ---------------------------------------------------
SIGNAL_PREFIX_CHARS = 3000
SPA_PREFIX_CHARS = 5000
SKELETON_MIN_HTML = 10_000
SKELETON_RATIO = 0.04
SKELETON_TEXT = 500
MIN_RESPONSE_CHARS = 500
MIN_EXTRACT_CHARS = 100
GOOD_CHARS = 5000
SPARSE_CHARS = 500
MAX_RETURN_CHARS = 95_000
PREVIEW_LINES = 35
MAX_SIGNALS = 3
MAX_REDIRECT_REQUESTS = 8
REDIRECT_STATUSES = [301, 302, 303, 307, 308]
GLOBAL_DEADLINE_MS = 12_000
STAGGER_MS = 1_500
TIER_CAPS_MS = {"tier1_curl": 7_000, "tier2_camoufox": 10_000, "tier3_nodriver": 12_000}
# Site handlers run before the tiers; a result longer than SPARSE_CHARS ends the request.
HANDLER_CAPS_MS = {"twitter_twikit": 7_000, "medium_freedium": 7_000, "medium_archive": 7_000}
# Of the handlers only this one leaves failures in the attempt list; the others fail silently.
LOGGED_HANDLER = "twitter_twikit"
NO_RESULT = "No content returned"
# A text from one of these sources is kept only when it is longer than each listed bound.
SOURCE_MIN_CHARS = {
    "tier2_camoufox": [100],
    "tier1_5_jina": [200],
    "mirror": [300],
    "archive": [300],
    "twitter_twikit": [500],
    "medium_freedium": [300, 500],
    "medium_archive": [300, 500],
}
OCR_MIN_CONFIDENCE = 0.4
OCR_MIN_CHARS = 50
SEARCH_MAX_RESULTS = 10

RELAY_SWITCH = "WEBSEARCH_ENABLE_EXTERNAL_RELAYS"
TIER3_SWITCH = "WEBSEARCH_ENABLE_UNSAFE_TIER3_BROWSER"
# Texts of a request for which no tier may run.
NO_TIERS = "No tiers available to run"
ENABLE_TIER3 = f"Set {TIER3_SWITCH}=1 to enable Tier 3 browser"

# --- fixed values: address blocks that are not globally reachable (IANA registries) ---------
IPV4_PRIVATE = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
IPV4_PUBLIC_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
IPV6_PRIVATE = [
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
]
IPV6_PUBLIC_EXCEPTIONS = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]
