"""Fixed values that must equal the original tool's for equal results.

Everything here is data, not logic: operators take these as default
arguments and every one of them can be replaced by the caller (a dict, a
list, or a small DataFrame).  Values are given in their natural order.
"""

from __future__ import annotations

# --- fixed values: processing defaults (code defaults, not the prose) -------
MIN_CONTENT_LENGTH = 5
MAX_CONTENT_LENGTH = 5000
SIMILARITY_THRESHOLD = 0.90
CONFIDENCE_THRESHOLD = 0.3
MAX_ROWS_PER_FILE = 10000
HIGH_QUALITY_MIN_SCORE = 0.5
HIGH_QUALITY_MIN_LENGTH = 20

# --- fixed values: topic lexicon (category -> keywords, declaration order) --
TOPIC_LEXICON: dict[str, list[str]] = {
    "ux_ui": ["interface", "design", "usability", "navigation", "ui", "ux", "user-friendly"],
    "pricing": ["price", "cost", "expensive", "cheap", "billing", "subscription", "payment"],
    "performance": ["slow", "fast", "lag", "crash", "bug", "stable", "performance", "loading"],
    "features": ["feature", "function", "capability", "tool", "option", "missing", "need"],
    "customer_service": ["support", "help", "service", "response", "staff", "customer care"],
    "content_quality": ["content", "quality", "selection", "variety", "catalog", "library"],
}

# --- fixed values: weighted sentiment lexicons -------------------------------
POSITIVE_WEIGHTS: dict[str, int] = {
    "excellent": 3, "amazing": 3, "outstanding": 3, "fantastic": 3,
    "great": 2, "good": 2, "wonderful": 2, "awesome": 3, "love": 2,
    "best": 2, "perfect": 3, "brilliant": 2, "superb": 2,
    "like": 1, "nice": 1, "fine": 1, "okay": 1, "decent": 1,
    "helpful": 1, "useful": 1, "easy": 1, "smooth": 1, "fast": 1,
}
NEGATIVE_WEIGHTS: dict[str, int] = {
    "terrible": 3, "awful": 3, "horrible": 3, "disgusting": 3, "trash": 3,
    "bad": 2, "poor": 2, "worst": 3, "hate": 2, "useless": 2,
    "broken": 2, "buggy": 2, "slow": 2, "crash": 2, "freezes": 2,
    "disappointed": 2, "frustrated": 2, "annoying": 1, "confusing": 1,
    "difficult": 1, "hard": 1, "problem": 1, "issue": 1, "error": 1,
}

# --- fixed values: simple (forum) sentiment word lists ------------------------
SIMPLE_POSITIVE = ["good", "great", "excellent", "amazing", "love", "best", "perfect", "awesome", "fantastic"]
SIMPLE_NEGATIVE = ["bad", "terrible", "awful", "hate", "worst", "horrible", "disgusting", "useless", "broken"]

# --- fixed values: cleaner spam patterns (applied to lower-cased text) -------
CLEANER_SPAM_PATTERNS = [
    r"(.)\1{10,}",
    r"[A-Z]{20,}",
    r"www\.",
    r"bit\.ly",
    r"click here",
    r"free money",
    r"buy now",
    r"limited time",
]

# --- fixed values: review spam patterns (de-dup stage) -----------------------
# Written with the whitespace class placeholder {WS} and the decimal digit
# class {D}; functions/text.py substitutes engine-neutral classes.
REVIEW_SPAM_PATTERNS = [
    r"visit{WS}+my{WS}+website",
    r"click{WS}+here",
    r"make{WS}+money",
    r"free{WS}+money",
    r"earn{WS}+\${D}+",
    r"work{WS}+from{WS}+home",
    r"buy{WS}+now",
    r"limited{WS}+time",
    r"act{WS}+fast",
    r"special{WS}+offer",
    r"http[s]?://",
    r"www\.",
    r"\.com",
    r"whatsapp",
    r"telegram",
    r"contact{WS}+me",
]

# --- fixed values: word lists ---------------------------------------------------
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
ENGLISH_MARKERS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
GENERAL_SOURCES = ["apps", "AppHookup", "androidapps", "iosgaming", "software"]
PREFERRED_TEXT_COLUMNS = ["text", "review", "review_text", "body", "content", "comment", "message", "desc", "description"]

# --- fixed values: sampling / truncation ------------------------------------------
SAMPLE_SIZE = 10
SAMPLE_TEXT_CUT = 600
PREVIEW_CUT = 100
INSIGHT_SAMPLE_CUT = 200
COMMENT_TITLE_CUT = 50

# --- fixed values: category -> forum mapping ----------------------------------
CATEGORY_SOURCES: dict[str, list[str]] = {
    "music_streaming": ["spotify", "music", "streaming", "playlists"],
    "video_streaming": ["netflix", "streaming", "movies", "television"],
    "transportation": ["uber", "rideshare", "transportation"],
    "travel": ["airbnb", "travel", "vacation"],
    "communication": ["slack", "workplace", "productivity"],
    "video_conferencing": ["zoom", "videoconferencing", "remotework"],
    "journaling": ["journaling", "diary", "productivity", "selfimprovement", "mentalhealth", "writing"],
}

# --- fixed values: app catalog (group, key, name, package/url, category, platforms, keywords, competitors)
APP_CATALOG = [
    ("mobile_apps", "spotify", "Spotify", "com.spotify.music", None, "music_streaming",
     ["android", "ios"], ["spotify", "music streaming", "playlist"], ["apple_music", "youtube_music", "amazon_music"]),
    ("mobile_apps", "netflix", "Netflix", "com.netflix.mediaclient", None, "video_streaming",
     ["android", "ios"], ["netflix", "streaming", "movies", "tv shows"], ["disney_plus", "hulu", "amazon_prime"]),
    ("mobile_apps", "uber", "Uber", "com.ubercab", None, "transportation",
     ["android", "ios"], ["uber", "rideshare", "taxi"], ["lyft", "taxi", "public_transport"]),
    ("mobile_apps", "airbnb", "Airbnb", "com.airbnb.android", None, "travel",
     ["android", "ios"], ["airbnb", "accommodation", "vacation rental"], ["booking", "hotels", "vrbo"]),
    ("mobile_apps", "day_one", "Day One", None, None, "journaling",
     ["reddit"], ["day one", "journal", "diary", "daily journal", "journaling app"], ["journey", "daily", "grid_diary", "momento"]),
    ("mobile_apps", "journey", "Journey", None, None, "journaling",
     ["reddit"], ["journey", "journal", "diary", "journaling", "memories"], ["day_one", "daily", "grid_diary", "momento"]),
    ("mobile_apps", "daily", "Daily - Journal & Diary", None, None, "journaling",
     ["reddit"], ["daily", "journal", "diary", "mood tracker", "daily journal", "daily notes", "habit tracker"],
     ["day_one", "journey", "grid_diary", "momento"]),
    ("web_apps", "slack", "Slack", None, "https://slack.com", "communication",
     None, ["slack", "team communication", "workplace chat"], ["microsoft_teams", "discord", "zoom"]),
    ("web_apps", "zoom", "Zoom", None, "https://zoom.us", "video_conferencing",
     None, ["zoom", "video calls", "meetings"], ["microsoft_teams", "google_meet", "skype"]),
]

# --- test lexicons (the synthetic corpus barely contains the English ones) ----
TEST_TOPIC_LEXICON: dict[str, list[str]] = {
    "alpha": ["the", "of"],
    "beta": ["and", "to"],
    "gamma": ["it", "was"],
    "delta": ["with", "by"],
}
TEST_POSITIVE_WEIGHTS: dict[str, int] = {"that": 3, "this": 2, "is": 1}
TEST_NEGATIVE_WEIGHTS: dict[str, int] = {"from": 3, "at": 2, "on": 1}
TEST_RELEVANCE_KEYWORDS = ["tion", "ing"]
