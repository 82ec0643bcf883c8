"""Fixed values shared by the Spark operators and the DuckDB oracle.

Everything here is a constant, written once and used by both engines so the
two sides cannot drift apart.
"""

from html.entities import html5

# --- fixed values: whitespace -------------------------------------------------
# Python's str.strip() is Unicode aware while Java's and RE2's \s are ASCII only,
# so the set is spelled out: exactly the characters Python calls whitespace.
WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
WS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in WS_CHARS) + "]"

# --- fixed values: HTML tokens ------------------------------------------------
# One alternation, leftmost-first: comments, raw-text elements (script, style,
# title, textarea) as single tokens, tags, text runs, and a lone '<'.  Whatever
# is not closed runs to the end of the page, as in a parser, so that each
# character is looked at once: a page of opened comments costs as much as any.
# Only a title ends at the next tag, so that an unclosed one keeps the page.
# '<' begins a tag only before a letter, '/', '!' or '?'; a quote opens a value
# only behind '='.  The possessive quantifiers keep Java's matcher iterative on
# hostile tags (tens of thousands of attributes); RE2 has no possessive form
# and never recurses, so the oracle uses the plain form.
RAW_TAGS = ("script", "style", "title", "textarea")
_TOKEN_ALTS = (
    r"<!--.*?(?:-->|\z)",
    *(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "textarea")),
    r"<title\b[^<>]*+>[^<]*+(?:</title\s*+>)?+",
    r"<[A-Za-z/!?](?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)",
    r"[^<]+",
    r"<",
)
TOKEN_RE = "(?is)" + "|".join(_TOKEN_ALTS)
TOKEN_RE_RE2 = TOKEN_RE.replace("++", "+").replace("*+", "*").replace("?+", "?")
# The same tokens with text first and the '<' that the other alternatives begin with looked at once.
TOKEN_RE_JAVA = "(?is)[^<]++|<(?:" + "|".join(a[1:] for a in _TOKEN_ALTS if a.startswith("<")) + ")"
RAW_RE = rf"(?i)^<(?:{'|'.join(RAW_TAGS)})\b"
RAW_TEXT_RE = rf"(?is)^<[^>]*>(.*?)(?:</(?:{'|'.join(RAW_TAGS)})\s*>)?$"
TEXT_RAW_TAGS = ("title", "textarea")  # raw elements whose content is text
# A tag closes itself by '/' behind its name, a space or a quote; elsewhere the
# '/' belongs to an unquoted value.
SELF_CLOSING_RE = r"(?s)(?:^<[A-Za-z][^\s/>]*|.[\s\"'])/>$"

# --- fixed values: start tags that end an open element of the same parent ------
# (the element's end tag may be left out in HTML)
IMPLIED_ENDS = {
    "p": ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol",
          "p", "pre", "section", "table", "ul"),
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "tbody", "tfoot"),
    "td": ("td", "th", "tr", "tbody", "tfoot"),
    "th": ("td", "th", "tr", "tbody", "tfoot"),
    "option": ("option", "optgroup"),
}

# --- fixed values: tags without attributes whose kind and name need no look at their characters
# (an element that is not named here is only slower)
PLAIN_NAMES = (
    "a abbr address article aside b blockquote body br button caption cite code col colgroup dd del details dfn div dl dt em "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label legend li main mark "
    "nav noscript ol optgroup option p pre q s samp section select small span strong sub summary sup table tbody td tfoot th "
    "thead time tr u ul var"
).split()
PLAIN_STARTS, PLAIN_ENDS = tuple(f"<{n}>" for n in PLAIN_NAMES), tuple(f"</{n}>" for n in PLAIN_NAMES)

# Attribute inside a start tag (the tag name already removed).
ATTR_RE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""

# --- fixed values: HTML void elements (no closing tag) -------------------------
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
)

# --- character references decoded in text and attributes ----------------------
# The named ones of HTML 5 from the standard library's table, by name without the ';', and the
# legacy names that need none; each is decoded once, so '&amp;lt;' becomes '&lt;'.
ENTITIES = {name[:-1]: text for name, text in sorted(html5.items()) if name.endswith(";")}
LEGACY_ENTITIES = {name: text for name, text in sorted(html5.items()) if not name.endswith(";")}
LEGACY_RE = "^(?:" + "|".join(sorted(LEGACY_ENTITIES, key=lambda name: (-len(name), name))) + ")"
REFERENCE_RE = r"&(?:#[0-9]{1,9};?|#[xX][0-9A-Fa-f]{1,7};?|[A-Za-z][A-Za-z0-9]{1,31}[;=]?)"
# Numbers 128 to 159 stand for the characters of windows-1252 (the control character where it has none).
C1_TEXT = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))

# --- fixed values: content and noise selectors (priority order) ---------------
CONTENT_SELECTORS = (
    "main", "article", ".post-content", ".entry-content", ".content",
    "[role='main']", ".post", ".hrecipe", "[itemtype*='Recipe']",
)
MAIN_NOISE_SELECTORS = (
    "script", "style", "noscript", ".advertisement", ".ads", ".ad-container",
    ".social-share", ".share-buttons", "[aria-hidden='true']",
)
PAGE_NOISE_SELECTORS = (
    "script", "style", "noscript", "iframe", "embed", "object", "nav",
    "header", "footer", "[role='navigation']", "[role='banner']",
    "[role='contentinfo']", "[aria-hidden='true']", ".advertisement", ".ads",
    ".ad-container", ".sidebar-ads", ".social-share", ".share-buttons",
    ".social-media", ".cookie-notice", ".newsletter-signup",
)
# Minimum text length (exclusive) for a main-content candidate.
MAIN_MIN_CHARS = 500

# --- fixed values: markdown links, text limits, markers ----------------------
LINK_RE = r"\[([^\]]+)\]\(([^)]+)\)"
LINK_TARGET_RE = r"\]\(([^)]+)\)"
ANGLE_TARGET_RE = r"\]\(<([^>]+)>\)"
TRUNCATION_MARKER = "\n...(truncated)"
MODEL_INPUT_CHARS = 100_000
NO_TITLE = "No Title"
HISTORY_CAP = 50
SNAPSHOT_EVERY = 3
DEFAULT_TEMPERATURE = 0.2
DEFAULT_MAX_TOKENS = 8192
DEFAULT_MODEL = "gemini/gemini-2.5-flash-lite-preview-06-17"
NO_CLIENT_NOTICE = (
    "## LLM not available\n\nNo completion function is configured, "
    "so this view cannot be produced."
)
