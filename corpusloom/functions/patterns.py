"""Patterns, word lists and limits that results depend on. Written for Java's regular expressions; all but
ROMAN and LOCALE are also valid RE2."""

CHALLENGE = (
    r"(?i)just a moment|attention required|captcha|verify you are (?:a )?human|are you a (?:human|robot)|"
    r"cf-browser-verification|enable javascript and cookies|unusual traffic|access denied|"
    r"before you continue|cookie consent|performing security verification|protect against malicious bots|verif(?:y|ies) you are"
)
LOGIN = r"(?i)\b(sign in|log ?in|api key required|unauthori[sz]ed|subscribe to (?:continue|read))\b"
ERROR_PAGE = r"(?i)\b(404|page not found|not found|page (?:doesn't|does not) exist|no longer available)\b"
BLOCK_REFUSAL = r"(?i)\b(?:blocked|access denied|request (?:was )?(?:rejected|blocked)|too many requests|forbidden|unusual traffic)\b"
BLOCK_VISITOR = (
    r"(?i)your (?:public )?ip(?: address)?|\b\d{1,3}(?:\.\d{1,3}){3}\b|captcha|are you a (?:robot|human)|try again later|"
    r"reference\s*#\s*\d+\.[0-9a-f.]+|ray id|incident id|support id"
)
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
JS_NEEDED = r"(?i)enable javascript|requires javascript|please turn on javascript|you need to enable javascript"
LISTING_WORDS = r"(?i)/(products?|catalog(ue)?|shop|collections?|all-products|docs|documentation|blog|articles|library)(/|$|\.)"
EDITORIAL = (
    r"(?i)/(blogs?|news(room)?|press(-?releases?|room)?|events?|careers?|jobs|investors?|about(-us)?|media|"
    r"webinars?|videos?|podcasts?|stories|insights|articles|authors?|tags?|partners?|partner-program|"
    r"request(-a)?(-(quote|demo|info|sample))?|contact(-us)?|where-to-buy|dealer-locator|find-a-(dealer|partner))(/|$)"
)
CATALOG = r"(?i)/(products?|catalog(ue)?|shop|store|collections?|parts?|items?)(/|$|\.)"
STALL = (
    r"(?i)timed out|ERR_HTTP2_PROTOCOL_ERROR|ERR_CONNECTION_RESET|ERR_EMPTY_RESPONSE|ERR_CONNECTION_CLOSED|"
    r"Connection reset|RemoteDisconnected|EOF occurred|Connection aborted"
)
ASSET = r"(?i)\.(jpg|jpeg|png|gif|svg|webp|css|js|ico|woff2?|ttf|mp4|mp3|zip)(\?|$)"
LOCALE = r"(?i)^(/(?:[a-z]{2}[-_])?[a-z]{2}(?:[-_][a-z]{2})?(?:/(?:[a-z]{2}[-_])?[a-z]{2}(?:[-_][a-z]{2})?)?)(?=/|$)"
ROMAN = r"(?<=[-_/=])[IVXLC]{1,7}(?=[-_./]|$)"
CHROME = (
    r"(?i)skip (?:navigation|to (?:main )?content)|menu website search|\bhref=|[.#][\w-]+\s*\{\s*[\w-]+\s*:|"
    r"lis learning center|register account\s*/|latest legislation:.{0,120}pdf: download|available versions of this section|"
    r"authenticate pdf resources search|full chapter text version list"
)
TRACKING = r"^(utm_|fbclid|gclid|mc_|ref$)"
STUBS = ("ha", "o", "he", "hese", "hey", "wih", "wha")
FUNCTION_WORDS = (
    "the of and to in a an or by for shall be is are any as on with that this which may not such from at "
    "under who its no if than each other all upon has have been"
).split()
STEER_STOP = (
    "the of and to in a an or by for with from on at as is are be this that which page pages section sections "
    "chapter title part article law laws code item items product products"
).split()
#: Outcomes, worst first, and the code each is reported under.
PRIORITY = (
    ("robots_disallowed", "ROBOTS_DISALLOWED"), ("blocked", "BLOCKED"), ("rate_limited", "RATE_LIMITED"), ("challenge", "CHALLENGE_WALL"), ("refused", "REFUSED"),
    ("silent_refusal", "SILENT_REFUSAL"), ("login_wall", "LOGIN_REQUIRED"), ("not_found", "NOT_FOUND"), ("error_page", "NOT_FOUND"), ("js_shell", "JS_SHELL"), ("thin", "THIN_CONTENT"),
    ("empty", "THIN_CONTENT"), ("want_miss", "WANT_MISS"), ("tls", "TLS_ERROR"), ("network", "NETWORK"), ("server_error", "SERVER_ERROR"), ("reader_missing", "READER_MISSING"),
    ("http_error", "HTTP_ERROR"), ("archive_throttled", "ARCHIVE_THROTTLED"), ("archive_held", "ARCHIVE_HELD"), ("no_archive", "NO_ARCHIVED_COPY"),
)
READERS = ("direct", "firecrawl", "crawl4ai", "browser")
RENDERERS = ("firecrawl", "crawl4ai", "browser")
DEAD_TTL, HOLD_S, ARCHIVE_HOLD, HOLD_MOST, EXCERPT, MIN_GOOD, PRUNE_TRIES, RING = 21600, 1800, 900, 86400, 6000, 300, 5, 2000
#: A location in a site map, a url in running text, and what a site map file's url looks like.
LOCATION = r"(?s)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"
BARE_URL = r"https?://[^\s<>\"')\]]+"
SITEMAP_FILE = r"(?i)sitemap|\.xml(\.gz)?$"
#: Windows of an excerpt at most, characters on each side of a match, characters of any answer at most.
WINDOWS, AROUND, FULL = 6, 300, 200_000
