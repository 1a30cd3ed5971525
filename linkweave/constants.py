"""Word lists, limits, patterns and text formats that results depend on.

Everything in this file is data, not logic.  Changing a value changes results.
"""

# The white-space characters that trimming and splitting recognise.
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the inside of a Java regex character class (Java's own \s is ASCII only).
WS_CLASS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Vocabulary every team starts with, in this order.
SEED_TAGS = [
    "javascript", "typescript", "python", "java", "go", "rust",
    "react", "vue", "angular", "nodejs", "express",
    "programming", "coding", "development", "software", "web development",
    "frontend", "backend", "fullstack", "api", "database",
    "tutorial", "documentation", "guide", "reference",
    "github", "open source", "repository", "code",
    "framework", "library", "tool", "utility",
    "ai", "machine learning", "ml", "llm", "openai",
    "design", "ui", "ux", "css", "html",
    "devops", "docker", "kubernetes", "aws", "cloud", "container",
]

# Words that never count as keywords.
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had",
    "her", "was", "one", "our", "out", "day", "get", "has", "him", "his",
    "how", "its", "may", "new", "now", "old", "see", "two", "who", "boy",
    "did", "does", "let", "put", "say", "she", "too", "use",
]

# HTML entities that are decoded, and their text.
HTML_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&#8212;": "—",
    "&#8211;": "–",
    "&#8220;": '"',
    "&#8221;": '"',
    "&#8217;": "'",
    "&#8216;": "'",
    "&amp;": "&",
}

# Word separators of the keyword splitter.  "/-_" is a range (U+002F to U+005F).
KEYWORD_SEPARATORS = "[" + WS_CLASS + r"/-_.,!?():]+"
# The same for texts without white space beyond ASCII, and the characters that make the full form necessary.
KEYWORD_SEPARATORS_ASCII = r"[ \t\n\x0B\f\r/-_.,!?():]+"
BEYOND_ASCII_SPACE = r"[\u00A0\u1680-\uFFFF]"
KEYWORD_MIN_LENGTH = 3

# Page patterns.  ws stands for the white-space class above.
TITLE_PATTERN = r"(?i)<title[^>]*>([^<]*)</title>"
META_PATTERN = r"""(?i)<meta[{ws}]+{attr}=["']{name}["'][{ws}]+content=["']([^"']*)"""
JSON_LD_PATTERN = (
    r"""(?i)<script[{ws}]+type=["']application/ld\+json["'][^>]*>([^<]*)</script>"""
)
TAXONOMY_LINK_PATTERN = (
    r"""(?i)<a[^>]*(?:class=["'][^"']*(?:tag|category|label)[^"']*["']"""
    r"""|href=["'][^"']*(?:tag|category)[^"']*["'])[^>]*>([^<]+)</a>"""
)
JSON_ARRAY_PATTERN = r"(?s)\[.*\]"

# Size limits.
MAX_TITLE = 500
MAX_DESCRIPTION = 1000
MAX_PAGE_BYTES = 1024 * 1024
MAX_MANUAL_TAGS = 10
MAX_MANUAL_TAG_LENGTH = 50
MAX_REPLY_TAGS = 10
MAX_REPLY_TAG_LENGTH = 50
MAX_MATCHES = 6
MAX_TAGS = 6
MAX_TAGS_WITH_MANUAL = 8
MAX_PAGE_TAGS = 10
MAX_PAGE_TAG_LENGTH = 30
SEARCH_LIMIT = 10
SEARCH_SHOWN = 5
RECENT_LIMIT = 10
SEED_TAG_LIMIT = 20
POPULAR_LIMIT = 20

# Scores of the match rules, strongest first.
SCORE_PERFECT = 15
SCORE_GRAMMATICAL = 12
SCORE_KEYWORD_IN_TAG = 8
SCORE_TAG_IN_KEYWORD = 5
FUZZY_MIN_SIMILARITY = 80
HIGH_SCORE = 15
HIGH_PAGE_TAG_SCORE = 10
MIN_PAGE_TAG_SCORE = 4

# Names of the match rules as they appear in reports.
MATCH_TYPES = {
    "perfect": 1,
    "grammatical-variation": 2,
    "keyword-in-tag": 4,
    "tag-in-keyword": 8,
    "fuzzy": 16,
}

# Error codes and messages.
CODE_VALIDATION = "VALIDATION_ERROR"
CODE_NOT_FOUND = "NOT_FOUND"
CODE_EXTERNAL = "EXTERNAL_SERVICE_ERROR"
MSG_URL_REQUIRED = "URL is required"
MSG_URL_INVALID = "Invalid URL format"
MSG_USER_REQUIRED = "User ID is required"
MSG_CHANNEL_REQUIRED = "Channel ID is required"
MSG_TOO_MANY_TAGS = "Too many manual tags (max 10)"
MSG_EMPTY_TAG = "Empty tags are not allowed"
MSG_LONG_TAG = "Tag too long (max 50 characters)"
MSG_TAGS_FAILED = "Failed to generate tags"
MSG_ID = "Bookmark with ID "
MSG_NOT_FOUND = " not found"
MSG_NOT_OWNED = " not found or not owned by user"
DEFAULT_TITLE = "Untitled"
UNPARSABLE_URL_TITLE = "Untitled Bookmark"

# Prompt formats.  @url@, @title@, @description@ and @tags@ are filled per link.
TAG_PROMPT_WITH_MATCHES = """\
Generate 3-5 specific, searchable tags for this bookmark.

URL: @url@
Title: @title@
Description: @description@

PREFER these existing tags if appropriate: @tags@

AVOID generic quality terms like: "clean output", "good article", "useful tool", "helpful resource", "great example", "awesome project", "best practices", "high quality"

PREFER specific terms like:
- Technology names (typescript, react, python, docker)
- Domain concepts (api, database, tutorial, documentation)
- Platform names (github, stackoverflow, npm)
- Concrete topics that help search (not subjective quality)

Requirements:
- Use lowercase, single words or short phrases (2-3 words max)
- Prioritize existing tags when they fit the content
- Each tag should help someone find this specific type of content
- Focus on WHAT the content is about, not HOW GOOD it is
- Return as JSON array of strings only"""

TAG_PROMPT = """\
Generate 3-5 specific, searchable tags for this bookmark:

URL: @url@
Title: @title@
Description: @description@

AVOID generic quality terms like: "clean output", "good article", "useful tool", "helpful resource", "great example", "awesome project", "best practices", "high quality"

PREFER specific terms like:
- Technology names (typescript, react, python, docker)
- Domain concepts (api, database, tutorial, documentation)
- Platform names (github, stackoverflow, npm)
- Concrete topics that help search (not subjective quality)

Requirements:
- Use lowercase, single words or short phrases (2-3 words max)
- Each tag should help someone find this specific type of content
- Focus on WHAT the content is about, not HOW GOOD it is
- Be specific and useful for search/organization
- Return as JSON array of strings only"""

SPECIFICITY_PROMPT = """\
Evaluate these bookmark tags for search specificity and usefulness. Remove any tags that are too generic, vague, or unhelpful for finding this specific content.

URL: @url@
Title: @title@
Description: @description@

Tags to evaluate: @tags@

REMOVE tags that are:
- Too generic (e.g., "superset" when it just means "extension of")
- Subjective quality terms (e.g., "clean", "good", "awesome")
- Overly broad concepts that don't help narrow search
- Conceptual relationships that aren't searchable terms

KEEP tags that are:
- Specific technology names (typescript, react, python)
- Concrete platforms or tools (github, npm, docker)
- Specific domain concepts (api, database, tutorial)
- Terms someone would actually search for to find this content

Return only the useful tags as a JSON array. If a tag is borderline, err on the side of keeping it."""

SPECIFICITY_MESSAGE = "Filter these tags: "
PROMPT_UNKNOWN = "Unknown"
PROMPT_NO_DESCRIPTION = "No description available"

# Base forms of common inflections of the seed vocabulary.
SEED_LEMMAS = {
    "programming": "program", "programs": "program", "programmed": "program",
    "coding": "code", "coded": "code", "codes": "code",
    "developments": "development",
    "databases": "database",
    "tutorials": "tutorial",
    "documentations": "documentation",
    "guides": "guide", "guided": "guide", "guiding": "guide",
    "references": "reference", "referenced": "reference", "referencing": "reference",
    "repositories": "repository",
    "frameworks": "framework",
    "libraries": "library",
    "tools": "tool", "tooled": "tool", "tooling": "tool",
    "utilities": "utility",
    "designs": "design", "designed": "design", "designing": "design",
    "dockers": "docker", "docked": "dock", "docking": "dock",
    "clouds": "cloud", "clouded": "cloud", "clouding": "cloud",
    "containers": "container",
    "goes": "go", "went": "go", "gone": "go", "going": "go",
    "reacts": "react", "reacted": "react", "reacting": "react",
    "expresses": "express", "expressed": "express", "expressing": "express",
    "rusts": "rust", "rusted": "rust", "rusting": "rust",
    "pythons": "python",
    "vues": "vue",
}
