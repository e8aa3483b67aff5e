"""The word lists and patterns that define what the engine finds.

All values in this module are given by the language they describe and are kept
as plain text in their natural order.  Patterns run on the match copy of a
sentence (see ``text.match_copy``), ignoring case unless said otherwise.
"""

# --- fixed values: sentence segmentation ------------------------------------
ABBREVIATIONS = ("u.s", "u.k", "e.g", "i.e", "etc", "inc", "ltd", "llc", "co", "corp", "mr", "mrs", "ms", "dr", "no", "vs", "st", "jr", "sr", "art", "sec", "para")
BULLETS = "•◦▪‣·"
DASHES = "-–—*"
CLOSERS = '"”’)'

# --- fixed values: categories, in order, with label and base severity --------
SEVERITIES = ("info", "caution", "warning")
SEVERITY_LABELS = {"info": "Info", "caution": "Caution", "warning": "Warning"}
CATEGORIES = (
    ("data_collection", "Categories of data collected", "info"),
    ("data_sale", "Language about selling data", "warning"),
    ("third_party_sharing", "Language about sharing data with third parties", "caution"),
    ("retention", "Language about data retention", "caution"),
    ("arbitration", "Language about binding arbitration", "warning"),
    ("class_action_waiver", "Language about class-action waiver", "warning"),
)
FOUND_LABEL, NOT_FOUND_LABEL, COUNT_LABEL = "Found", "Not found", "{count} matched sentence(s)"

SCANNED = "Scanned “{title}” — {count} characters of text."
NO_TITLE = "this page"
THIN_NOTE = "Too little readable text; scan a selection or paste the text instead."
ERROR_NOTE = "This page cannot be read; scan a selection or paste the text instead."

# --- fixed values: data collection -------------------------------------------
SENSITIVE = (
    r"\bsocial\s+security\s+number",
    r"\bdriver'?s?\s+licen[cs]e",
    r"\bpassport\b",
    r"\b(?:financial|bank)\s+(?:account|information)\b",
    r"\b(?:credit|debit)\s+card\b",
    r"\bmedical\s+(?:information|records?|history|conditions?)\b",
    r"\bhealth\s+(?:information|data|records?|insurance)\b",
    r"\bprotected\s+classifications?\b",
    r"\b(?:race|ethnicity|national\s+origin|sexual\s+orientation|religious\s+beliefs?)\b",
    r"\bbiometric\b",
    r"\bsensory\s+(?:data|information)\b",
    r"\b(?:fingerprints?|faceprints?|voiceprints?)\b",
    r"\bprecise\s+(?:geo)?location\b",
    r"\bgeolocation\b",
    r"\b(?:location|position)\b[\s\S]{0,80}?\b(?:gps|bluetooth|wi-?fi|cell\s+tower)\b",
    r"\b(?:gps|bluetooth|wi-?fi)\b[\s\S]{0,60}?\b(?:location|geolocation|tracking)\b",
    r"\bsession[- ]replay\b",
    r"\bkeystrokes?\b",
    r"\bmouse\s+movements?\b",
    r"\bscreen\s+recordings?\b",
    r"\binferences?\s+(?:drawn|about|regarding)\b",
    r"\b(?:create|build|develop)\b[\s\S]{0,40}?\ba?\s*profile\s+(?:about|of|reflecting)\b",
    r"\bprofiling\b",
)
SENSITIVE_CASED = (r"\bSSN\b",)
ACT_VERBS = "collect|use|sell|share|show|display|process|retain|store|disclose|require|request|ask|engage|participate|conduct|perform|track|monitor|profile"
COLLECTION_DENIED = (
    rf"\b(?:do|does|did|will|would|shall)\s+not\s+(?:[a-z']+\s+){{0,3}}?(?:{ACT_VERBS})\b",
    rf"\b(?:don't|doesn't|didn't|won't|don’t|doesn’t|didn’t|won’t)\s+(?:[a-z']+\s+){{0,3}}?(?:{ACT_VERBS})\b",
    rf"\bnever\s+(?:[a-z']+\s+){{0,2}}?(?:{ACT_VERBS})\b",
)
ORDINARY = (
    r"\bcollect\w*\b[\s\S]{0,160}?\b(?:name|alias|email|phone|postal\s+address|address|date\s+of\s+birth|identifiers?|device|ip\s+address|browsing|search\s+history|usage|cookies?|contacts?|payment|account|purchase)\b",
    r"\bcategories\s+of\s+personal\s+(?:information|data)\b",
    r"\bidentifiers\s+such\s+as\b",
    r"\binformation\s+(?:we|you)\s+(?:collect|provide)\b",
    r"\b(?:personal|your)\s+(?:data|information)\b[\s\S]{0,60}?\b(?:is|are|will\s+be)\s+collected\b",
)

# --- fixed values: data sale --------------------------------------------------
QUOTED_WORD = r"""["“‘']([A-Za-z][A-Za-z-]{0,25})["”’']"""
SALE_RIGHTS = (
    r"^(?:exercising\s+)?(?:the\s+|your\s+)?right\s+to\b",
    r"\b(?:you|consumers?|residents?|users?)\s+(?:also\s+)?ha(?:ve|s)\s+(?:a|the|certain)\s+right\b",
    r"\b(?:you|consumers?|residents?|users?)\s+(?:may|can|could|are\s+entitled\s+to)\s+(?:request|direct|ask|opt|object|choose|submit)\b",
    r"\bopt(?:ing)?[- ]?out\s+(?:of|from)\s+(?:the\s+)?(?:sale|selling|sharing)\b",
    r"\brequest\s+that\s+we\s+disclose\b",
    r"\bdo\s+not\s+sell\s+my\b",
)
SALE_STRONG = (
    r"\ballow\b[\s\S]{0,160}?\bcollect\b[\s\S]{0,160}?\bin\s+exchange\s+for\b",
    r"\bnon-?monetary\s+consideration\b",
    r"\bin\s+exchange\s+for\b[\s\S]{0,60}?\bconsideration\b",
    r"\bwe\s+(?:may\s+)?ha(?:ve|d)\s+sold\b",
    r"\bsold\s+the\s+following\s+categories\b",
)
SALE_STRONG_DENIED = r"\bnot\s+(?:[a-z]+\s+){0,3}?sell\b[\s\S]{0,80}?\bin\s+exchange\s+for\b[\s\S]{0,60}?\bconsideration\b"
SALE_CONTRAST = r"\b(?:however|but|although|though|except|nevertheless|nonetheless)\b[,;:]?\s"
SALE_POSITIVE = (
    r"\b(?:sell|sells|selling|sold)\b[\s\S]{0,80}?\b(?:personal|your|user|customer|consumer)\b[\s\S]{0,30}?\b(?:data|information)\b",
    r"\bsale\s+of\b[\s\S]{0,40}?\b(?:personal|your|user|customer|consumer)\b[\s\S]{0,30}?\b(?:data|information)\b",
    r"\b(?:personal|your|user)\b[\s\S]{0,30}?\b(?:data|information)\b[\s\S]{0,60}?\b(?:is|are|may be|will be|can be)\s+sold\b",
    r"\b(?:considered|constitutes?|deemed)\b[\s\S]{0,20}?\b(?:selling|sale|sold|sell)\b[\s\S]{0,120}?\b(?:law|laws|ccpa|cpra)\b",
    r"\bpersonal\s+(?:data|information)\b[\s\S]{0,120}?\b(?:sold|selling)\b",
    r"\b(?:sold|sell|selling)\b\s+(?:and/or|and|or)\s+(?:shared|sharing|share)\b",
)
SALE_DENIED = (
    r"\b(?:do|does|did|will|shall|would)\s+not\s+(?:[a-z]+\s+){0,3}?sell\b",
    r"\b(?:don't|won't|doesn't|didn't|don’t|won’t|doesn’t|didn’t)\s+(?:[a-z]+\s+){0,3}?sell\b",
    r"\bnever\s+(?:[a-z]+\s+){0,2}?(?:sell|sold)\b",
    r"\bnot\s+to\s+sell\b",
    r"\bwithout\s+selling\b",
    r"\bno\s+sale\s+of\b",
    r"\b(?:is|are|was|were)\s+not\s+(?:[a-z]+\s+){0,2}?sold\b",
    r"\bsell\s+or\s+transfer\b[\s\S]{0,80}?\b(?:business|assets)\b",
)
SALE_QUALIFIED_DENIAL = r"\b(?:do|does|did|will|shall|would)\s+not\s+(?:[a-z]+\s+){0,2}?(?:sell|transfer|provide|disclose|share)\b[\s\S]{0,80}?\bin\s+exchange\s+for\b[\s\S]{0,40}?\b(?:payment|money|monetary|compensation|consideration)\b"
SALE_DISCLOSURE = r"\b(?:provide|share|disclose|give|allow|transfer|sell)\b[\s\S]{0,100}?\b(?:data|information)\b"
SALE_TAIL_DENIED = r"\b(?:do|does|did|will|would|shall)\s+not\b|\bnever\b"

# --- fixed values: third-party sharing ------------------------------------------
RECIPIENTS = "|".join((
    r"third[- ]part(?:y|ies)", r"affiliates?", r"affiliated\s+(?:entities|companies)", r"subsidiaries", r"parent\s+compan(?:y|ies)", r"service\s+providers?", r"business\s+partners?",
    r"financial\s+(?:institutions?|partners?)", r"payment\s+(?:networks?|processors?)", r"advertis\w+", r"analytics\s+providers?", r"social\s+networks?", r"professional\s+advis[oe]rs?",
    r"member\s+stations?", r"government\s+(?:entities|agencies)", r"authorit(?:y|ies)", r"data\s+brokers?", r"vendors?", r"contractors?",
))
SHARE_VERBS = "share|shares|shared|sharing|disclose|discloses|disclosed|disclosure"
LEGAL_DEMANDS = (
    r"subpoenas?|court\s+orders?|search\s+warrants?|warrants?|legal\s+process|legal\s+(?:demand|request|proceeding|obligation)s?|lawful\s+requests?|(?:valid|lawful|binding)\s+orders?|"
    r"law\s+enforcement|regulatory\s+authorit\w+|public\s+authorit(?:y|ies)|judicial\s+authorit\w+|(?:relevant|government(?:al)?)\s+authorit(?:y|ies)"
)
DATA_NOUNS = "[Tt]ext|[Mm]essages?|[Aa]udio|[Vv]oice|[Dd]ata|[Ii]nformation|[Cc]ontent|[Rr]ecordings?|[Ff]iles?|[Dd]ocuments?|[Pp]hotos?|[Vv]ideos?"
NOT_RECIPIENTS = "We|Us|You|Your|Our|The|This|These|Those|Such|Personal|Services?|Customers?|Users?"
SHARING_POSITIVE = (
    rf"\b(?:{SHARE_VERBS})\b[\s\S]{{0,120}}?\b(?:{RECIPIENTS})\b",
    rf"\bprovid(?:e|es|ed|ing)\b[\s\S]{{0,80}}?\b(?:personal|your|user|customer|consumer)\b[\s\S]{{0,30}}?\b(?:data|information)\b[\s\S]{{0,120}}?\b(?:{RECIPIENTS})\b",
    rf"\b(?:disclos\w+|shar\w+|provid\w+|releas\w+|produc\w+|hand(?:ed|s)?\s+over|turn(?:ed|s)?\s+over)\b[\s\S]{{0,120}}?\b(?:{LEGAL_DEMANDS})\b",
    rf"\b(?:comply\s+with|in\s+response\s+to|respond\s+to|pursuant\s+to)\b[\s\S]{{0,60}}?\b(?:{LEGAL_DEMANDS})\b",
    r"\b(?:disclos\w+|shar\w+|provid\w+|releas\w+)\b[\s\S]{0,100}?\b(?:required|permitted)\s+(?:or\s+permitted\s+)?by\s+(?:applicable\s+)?law\b",
    rf"\b(?:{RECIPIENTS})\b[\s\S]{{0,80}}?\b(?:share|shares|disclose|discloses|transfer|transfers)\b[\s\S]{{0,80}}?\b(?:personal|your|user)\b[\s\S]{{0,40}}?\b(?:data|information)\b",
    rf"\b(?:{RECIPIENTS})\b[\s\S]{{0,80}}?\b(?:receive|receives|access|collect|obtain)\b[\s\S]{{0,60}}?\b(?:personal|your|user)\b[\s\S]{{0,30}}?\b(?:data|information)\b",
    r"\bwe\s+(?:may\s+|will\s+|might\s+)?(?:share|disclose|display)\b[\s\S]{0,120}?\bother\s+(?:\w+\s+)?(?:users|account\s+holders|members)\b",
    r"^(?:advertising\s+networks?|internet\s+service\s+providers?|data\s+analytics\s+providers?|social\s+(?:networks?|media(?:\s+platforms)?)|government\s+entities|data\s+brokers?|operating\s+systems(?:\s+and\s+platforms)?)\.?\z",
    r"\bsell\s+or\s+transfer\b[\s\S]{0,80}?\b(?:business|assets)\b",
    r"\bin\s+the\s+event\s+of\b[\s\S]{0,80}?\b(?:merger|acquisition|bankruptcy|reorganization|sale\s+of\s+(?:our\s+)?assets)\b",
    r"\b(?:merger|acquisition|bankruptcy|reorganization)\b[\s\S]{0,100}?\b(?:personal|your)\b[\s\S]{0,30}?\b(?:data|information)\b[\s\S]{0,60}?\btransferr?\w*\b",
    r"\b(?:transferr?\w*|process\w*|stor\w+)\b[\s\S]{0,100}?\b(?:outside|abroad|other\s+countries|across\s+borders|internationally|cross[- ]border)\b",
    r"\bcountries\s+other\s+than\b",
    r"\btransferred\s+to\b[\s\S]{0,60}?\bunited\s+states\b",
)
#: Case matters; the name after "with" must not be one of NOT_RECIPIENTS.
SHARED_WITH_CASED = (rf"\b(?:{DATA_NOUNS})\b[\s\S]{{0,200}}?\b(?:shared?|disclosed?)\s+with\s+", r"[A-Z][A-Za-z.]+(?:\s+(?:or|and|&)\s+[A-Z][A-Za-z.]+)*")
SHARING_DENIED = (
    r"\b(?:do|does|did|will|shall|would)\s+not\s+(?:[a-z]+\s+){0,3}?(?:share|disclose|sell|transfer)\b",
    r"\b(?:don't|won't|doesn't|didn't|don’t|won’t|doesn’t|didn’t)\s+(?:[a-z]+\s+){0,3}?(?:share|disclose|sell|transfer)\b",
    r"\bnever\s+(?:[a-z]+\s+){0,2}?(?:share|disclose|sell)\b",
)
SHARING_EXCEPTION = r"\b(?:except|unless|other\s+than)\b"
SHARING_CONTRAST = r"\b(?:however|but|although|though|nevertheless|nonetheless)\b[,;:]?\s"
SHARING_DENIED_DATA = (
    r"\bnot\s+(?:[a-z]+\s+){0,3}?(?:share|disclose|sell|transfer)\b[\s\S]{0,80}?\b(?:personal|your|user)\b[\s\S]{0,40}?\b(?:data|information)\b",
    r"\bnever\s+(?:[a-z]+\s+){0,2}?(?:share|disclose|sell)\b[\s\S]{0,80}?\b(?:personal|your|user)\b[\s\S]{0,40}?\b(?:data|information)\b",
)

# --- fixed values: retention --------------------------------------------------
RETENTION_CONTEXT = r"\b(?:retain\w*|retention|keep\w*|kept|stor\w+|delet\w+|preserve\w*|maintain\w*|hold|held)\b"
RETENTION_VAGUE = (
    r"\bas\s+long\s+as\s+(?:necessary|needed|required|reasonably)\b",
    r"\bduration\s+of\s+(?:our|your|the)\s+relationship\b",
    r"\breasonable\s+(?:period|time|amount\s+of\s+time)\b",
    r"\bindefinite(?:ly)?\b",
    r"\bfor\s+as\s+long\s+as\b",
    r"\buntil\s+(?:it\s+is\s+)?no\s+longer\s+(?:needed|necessary|required)\b",
    r"\bas\s+(?:required|permitted)\s+by\s+(?:applicable\s+)?law\b",
    r"\b(?:business|legal|operational)\s+(?:purposes?|needs?|requirements?|obligations?)\b",
    r"\bfor\s+(?:different|differing|varying|various)\s+(?:periods?|lengths?\s+of\s+time|amounts?\s+of\s+time)\b",
    r"\bdepend(?:s|ing)?\s+on\s+(?:what|how|the\s+(?:type|nature|purpose|amount|sensitivity))\b",
    r"\bcriteria\s+(?:used\s+)?(?:to\s+determine|for\s+determining|we\s+use)\b",
    r"\b(?:consider|take\s+into\s+account)\b[\s\S]{0,60}?\b(?:amount|nature|sensitivity)\b[\s\S]{0,60}?\b(?:information|data|personal)\b",
    r"\bfactors?\b[\s\S]{0,50}?\b(?:affect|determine|influence)\b[\s\S]{0,40}?\bretention\b",
)
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|eighteen|twenty|twenty-four|thirty|sixty|ninety"
RETENTION_SPECIFIC = (
    r"\b\w+\s+\(\d+\)\s+(?:day|week|month|year)s?\b",
    r"\b\d+\s+\([a-z]+\)\s+(?:day|week|month|year)s?\b",
    r"\b\d+\s+(?:day|week|month|year)s?\b",
    rf"\b(?:{NUMBER_WORDS})\s+(?:day|week|month|year)s?\b",
)

# --- fixed values: arbitration and class-action waiver ----------------------------
ARBITRATION = (
    r"\b(?:binding|mandatory|final)\s+arbitration\b",
    r"\b(?:resolved?|settled?|decided)\b[\s\S]{0,60}?\b(?:through|by|via|in)\s+(?:individual\s+)?arbitration\b",
    r"\barbitration\s+(?:agreement|clause|provision)\b",
    r"\bagreement\s+to\s+arbitrate\b",
    r"\bsubmit\b[\s\S]{0,60}?\bto\s+arbitration\b",
    r"\bwaiv(?:e|er|ing)\b[\s\S]{0,80}?\b(?:right|rights)\b[\s\S]{0,80}?\b(?:court|jury|judge|sue)\b",
)
CLASS_WAIVER = (
    r"\bclass[\s-]action\s+waiver\b",
    r"\bwaiv(?:e|er|ing)\b[\s\S]{0,100}?\bclass\b",
    r"\bclass\b[\s\S]{0,60}?\bwaiv(?:e|er|ed|ing)\b",
    r"\bnot\s+as\s+a\b[\s\S]{0,40}?\b(?:plaintiff|class\s+member|member\s+of\s+a\s+class)\b",
    r"\bno\s+(?:class|representative|collective)\s+(?:actions?|proceedings?|arbitrations?)\b",
    r"\b(?:claims?|disputes?|proceed(?:ings?)?|arbitrations?|actions?)\b[\s\S]{0,160}?\bindividual\s+basis\b",
    r"\bindividual\s+basis\b[\s\S]{0,80}?\b(?:claims?|disputes?|class|collective|representative)\b",
    r"\bclass\s+or\s+collective\s+actions?\b",
)

# --- fixed values: candidate misses ----------------------------------------------
MISS_FAMILIES = (
    ("sale", ("sell", "sold", "sale", "in exchange", "consideration"), ("data_sale",)),
    ("sharing", ("share", "disclos"), ("third_party_sharing",)),
    ("advertising", ("advertis", "ad partner", "ad network", "interest-based"), ("data_sale", "third_party_sharing")),
    ("retention", ("retain", "retention", "as long as", "period"), ("retention",)),
)
SAMPLE_CLIP, MISS_CLIP = 90, 140
TOTALS_HEAD = "=== totals across all documents ==="
EXCERPT_PREFIX, LOCAL_PREFIX = "excerpt:", "local:"

# --- fixed values: pages --------------------------------------------------------
POLICY_URL = r"privacy|data[-_]?protection|data[-_]?policy|cookie[-_]?policy|gdpr|ccpa|legal/privacy"
POLICY_TITLE = r"privacy\s+(?:policy|notice|statement|center)|data\s+(?:policy|protection)|cookie\s+(?:policy|notice)"
TOOLBAR_SIGNALS = ("privacy", "privacy-policy", "legal/privacy", "privacy-notice")
BLOCK_MARKERS = ("enable javascript", "javascript is required", "javascript is disabled", "access denied", "captcha", "are you a robot", "verify you are human", "attention required", "request blocked")
THIN_LENGTH, FETCH_LENGTH, MARKER_WINDOW, MARKER_LENGTH = 200, 2000, 4000, 8000
HEADING_LENGTH, PARAGRAPH_LENGTH, LABEL_REPEATS = 60, 40, 3
DROPPED_ELEMENTS = ("script", "style", "noscript", "template", "svg", "iframe", "head")
CHROME_ELEMENTS = ("nav", "header", "footer", "aside", "form", "button", "select")
BREAK_ELEMENTS = ("br", "hr")
LINE_ELEMENTS = r"p|div|li|ul|ol|h[1-6]|tr|td|th|table|section|blockquote|dt|dd|dl|figure|summary|details"
DOM_BLOCK_TAGS = ("p", "div", "section", "article", "header", "footer", "aside", "main", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
                  "blockquote", "pre", "figure", "figcaption", "br", "hr")
DOM_HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
JUMP_LINKS, JUMP_SHARE, JUMP_TEXT_SHARE = 3, 0.8, 0.7
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "ndash": "–", "mdash": "—", "hellip": "…", "copy": "©", "reg": "®", "trade": "™"}
