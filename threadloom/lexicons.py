"""Word lists, rules and lookup tables.

Everything below is a fixed value that results depend on; it is stated as plain text. Any of
these tables can be replaced by a DataFrame of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEXICON_SCHEMA = (
    "module string, module_name string, term string, category string, severity int,"
    " factors array<string>"
)
RULE_SCHEMA = (
    "ruleset_id string, rule_id string, name string, type string, pattern string, priority int,"
    " enabled boolean, action string"
)

# Fixed values: (module, name, polarity, group, weight, factor letters).
MODULES = [
    ("gaslighting", "Gaslighting Detection", "negative", "manipulation", 90, ["j", "k", "l"]),
    ("blame_shifting", "Blame Shifting", "negative", "manipulation", 85, ["j", "l"]),
    ("minimization", "Minimization & Dismissal", "negative", "manipulation", 75, ["f", "j"]),
    ("threats_intimidation", "Threats & Intimidation", "negative", "control", 95, ["j", "l"]),
    ("isolation_tactics", "Isolation Tactics", "negative", "control", 85, ["j", "k"]),
    ("financial_control", "Financial Control", "negative", "control", 80, ["c", "j"]),
    ("emotional_blackmail", "Emotional Blackmail", "negative", "manipulation", 85, ["f", "j"]),
    ("stonewalling", "Stonewalling & Silent Treatment", "negative", "control", 70, ["f", "k"]),
    ("parental_alienation", "Parental Alienation", "negative", "custody", 95, ["i", "j", "k"]),
    ("projection", "Projection", "negative", "manipulation", 75, ["j", "l"]),
    ("love_bombing", "Love Bombing", "positive", "affection", 80, ["l"]),
    ("future_faking", "Future Faking", "positive", "promises", 75, ["l"]),
    ("affirmations", "Positive Affirmations", "positive", "affection", 50, []),
    ("apologies", "Apologies & Remorse", "positive", "reconciliation", 60, ["l"]),
    ("gift_giving", "Gift Giving & Generosity", "positive", "affection", 55, ["c"]),
    ("scheduling", "Scheduling & Custody", "neutral", "logistics", 40, ["a", "b", "d"]),
    ("child_wellbeing", "Child Wellbeing Mentions", "neutral", "children", 50, ["a", "b", "e", "g"]),
]

# Phrases per module.
PHRASES = {
    "gaslighting": [
        "that never happened", "you're imagining things", "you're crazy", "you're being paranoid",
        "you're too sensitive", "you're overreacting", "i never said that",
        "you're making things up", "that's not what happened", "you have a bad memory",
        "no one else thinks that", "everyone agrees with me", "you're the only one who",
        "you always twist things", "you're delusional",
    ],
    "blame_shifting": [
        "this is your fault", "you made me", "if you hadn't", "because of you", "you started it",
        "look what you made me do", "you drove me to", "you pushed me to",
        "this wouldn't happen if you", "you bring out the worst", "you're the reason",
        "it's because you",
    ],
    "minimization": [
        "it's not a big deal", "you're blowing this out of proportion", "it wasn't that bad",
        "get over it", "move on already", "stop dwelling", "it's in the past", "let it go",
        "you're making a mountain", "calm down", "relax", "chill out", "it's nothing",
        "don't be dramatic",
    ],
    "threats_intimidation": [
        "you'll regret", "you'll be sorry", "i'll make sure", "you'll never see",
        "i'll take the kids", "i'll destroy", "i'll ruin", "you'll pay for", "watch what happens",
        "don't test me", "you don't want to", "i'll tell everyone", "i'll expose",
        "you'll lose everything", "or else",
    ],
    "isolation_tactics": [
        "your family is toxic", "your friends don't care", "they're using you",
        "they're against us", "you don't need them", "i'm the only one",
        "no one understands you like i do", "they're jealous", "they're trying to break us up",
        "you spend too much time with", "choose me or them", "it's us against the world",
    ],
    "emotional_blackmail": [
        "after everything i've done", "if you loved me", "you owe me", "i sacrificed",
        "i gave up everything", "how could you do this to me", "you're hurting me",
        "you're breaking my heart", "i can't live without", "i'll hurt myself",
        "you'll destroy me", "i thought you cared",
    ],
    "stonewalling": [
        "i'm not talking about this", "conversation is over", "i have nothing to say",
        "talk to my lawyer", "don't contact me", "leave me alone", "i'm done", "whatever", "fine",
        "i don't care", "do what you want",
    ],
    "parental_alienation": [
        "your father doesn't love", "your mother doesn't love", "daddy doesn't care",
        "mommy doesn't care", "daddy doesn't love", "mommy doesn't love", "they abandoned",
        "they chose", "they don't want to see you", "it's their fault", "they're the bad guy",
        "don't tell them", "our little secret", "they'll be mad at you", "they don't understand",
        "you're better off without",
    ],
    "love_bombing": [
        "you're perfect", "you're my everything", "i've never felt this way",
        "you're my soulmate", "we're meant to be", "i can't live without you", "you complete me",
        "you're the best thing", "i've never loved anyone like", "you're amazing",
        "you're incredible", "i'm so lucky", "you're too good for me",
    ],
    "future_faking": [
        "when we get married", "when we have kids", "i'm going to buy you",
        "we'll travel the world", "i'll change", "things will be different", "i promise to",
        "next time", "soon we'll", "one day we'll", "i'll make it up to you", "just wait until",
    ],
    "apologies": [
        "i'm sorry", "i apologize", "please forgive me", "i was wrong", "i made a mistake",
        "i shouldn't have", "i regret", "i feel terrible", "i'll do better",
        "give me another chance", "i didn't mean to",
    ],
    "projection": [
        "you're the one who", "you always", "you never", "you're cheating", "you're lying",
        "you're manipulating", "you're controlling", "you're abusive", "you're the narcissist",
        "you're gaslighting me",
    ],
}

# Screening groups (group, severity, factor, type, patterns). Names of protected
# persons are a parameter of the screening operator, not part of this table.
SCREENING = [
    ("child_reference", 8, "a", "child_reference", [
        r"\bmy daughter\b", r"\bour daughter\b", r"\bthe baby\b", r"\bthe kid\b",
        r"\bthe child\b", r"\bour child\b", r"\bmy kid\b",
    ]),
    ("call_blocking", 10, "k", "communication_blocking", [
        r"\bblock(ed|ing)?\s+(your|his|the)?\s*call", r"\bcan'?t\s+call",
        r"\bwon'?t\s+(let|allow)\s+(you|him)\s+call", r"\bno\s+phone\s+(calls?|contact)",
        r"\bdon'?t\s+call", r"\bstop\s+calling", r"\bignor(e|ed|ing)\s+(your|his|the)?\s*call",
        r"\brefus(e|ed|ing)\s+to\s+answer",
    ]),
    ("visit_blocking", 10, "k", "parental_alienation", [
        r"\bblock(ed|ing)?\s+(your|his|the)?\s*visit", r"\bcan'?t\s+see\s+(her|him)",
        r"\bwon'?t\s+(let|allow)\s+(you|him)\s+(see|visit)", r"\bno\s+visitation",
        r"\bcancel(ed|ing)?\s+(your|his|the)?\s*(visit|time)",
        r"\bdenied?\s+(your|his)?\s*(visit|time|access)", r"\bkeep(ing)?\s+(her|him)\s+from",
        r"\bwon'?t\s+bring\s+(her|him)", r"\brefus(e|ed|ing)\s+to\s+(bring|drop\s+off)",
    ]),
    ("parenting_time_denial", 9, "k", "custody_interference", [
        r"\bno\s+parenting\s+time", r"\bcan'?t\s+have\s+(your|his)\s+time",
        r"\bdenied?\s+parenting\s+time", r"\binterfere?\s+with\s+(your|his)\s+time",
        r"\bnot\s+(your|his)\s+weekend", r"\bchanged?\s+(the|our)\s+schedule",
        r"\bshe'?s\s+(busy|sick|not\s+available)", r"\bcan'?t\s+make\s+it",
    ]),
    ("custody_interference", 10, "k", "custody_interference", [
        r"\bkeep(ing)?\s+(her|him|the\s+child)", r"\bhide?\s+(her|him|the\s+child)",
        r"\bwon'?t\s+(let|allow)\s+(you|him)\s+(have|see)", r"\bmy\s+child\s+now",
        r"\bnot\s+(your|his)\s+(daughter|child|kid)", r"\bstay\s+away\s+from", r"\bno\s+contact",
        r"\brestraining\s+order", r"\bcall(ed|ing)?\s+(the\s+)?police",
    ]),
]

# Modules that contradict an earlier or later declaration of love.
DEVALUATION_MODULES = ["gaslighting", "blame_shifting", "minimization", "threats_intimidation"]

# Built-in rule sets.
RULES = [
    ("builtin-pii-detection", "pii-email", "Email Address", "regex",
     r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 10, True, "flag"),
    ("builtin-pii-detection", "pii-phone", "Phone Number", "regex",
     r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", 10, True, "flag"),
    ("builtin-pii-detection", "pii-ssn", "Social Security Number", "regex",
     r"\b\d{3}-\d{2}-\d{4}\b", 20, True, "flag"),
    ("builtin-pii-detection", "pii-credit-card", "Credit Card Number", "regex",
     r"\b(?:\d{4}[-\s]?){3}\d{4}\b", 20, True, "flag"),
    ("builtin-code-quality", "code-todo", "TODO Comment", "keyword",
     "TODO,FIXME,HACK,XXX", 5, True, "label"),
    ("builtin-code-quality", "code-console-log", "Console Log", "regex",
     r"console\.log\s*\(", 3, True, "flag"),
    ("builtin-code-quality", "code-debugger", "Debugger Statement", "keyword",
     "debugger", 10, True, "flag"),
]

# Structural rule names and their patterns.
STRUCTURES = {
    "has-heading": r"(?m)^#{1,6}\s+.+$",
    "has-list": r"(?m)^[-*+]\s+.+$",
    "has-code-block": r"```[\s\S]*?```",
    "has-table": r"\|.+\|",
    "has-link": r"\[.+\]\(.+\)",
    "has-image": r"!\[.+\]\(.+\)",
}

# Confidence per rule type.
RULE_CONFIDENCE = {"regex": 1.0, "keyword": 0.9, "path": 0.8, "structural": 0.95}

# Entity patterns in evaluation order.
ENTITY_PATTERNS = [
    ("DATE", r"\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b"),
    ("DATE", r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October"
             r"|November|December)\s+\d{1,2},?\s+\d{4}\b"),
    ("TIME", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b"),
    ("MONEY", r"(?i)\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|trillion))?"),
    ("MONEY", r"[\d,]+(?:\.\d{2})?\s*(?:USD|EUR|GBP|JPY)"),
    ("PERCENT", r"\b\d+(?:\.\d+)?%"),
    ("ORG", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PRODUCT", r"https?:\/\/[^\s]+"),
    ("PERSON", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"),
]

# Function words and scripts per language, in tie-breaking order.
LANGUAGE_MARKERS = {
    "en": [r"\bthe\b", r"\band\b", r"\bis\b", r"\bof\b", r"\bto\b"],
    "es": [r"\bel\b", r"\bla\b", r"\bde\b", r"\bque\b", r"\by\b"],
    "fr": [r"\ble\b", r"\bla\b", r"\bde\b", r"\bet\b", r"\best\b"],
    "de": [r"\bder\b", r"\bdie\b", r"\bund\b", r"\bist\b", r"\bein\b"],
    "zh": ["[一-鿿]"],
    "ja": ["[぀-ゟ]", "[゠-ヿ]"],
    "ko": ["[가-힯]"],
}

# Keyword stop words.
KEYWORD_STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one",
    "our", "out", "has", "have", "been", "were", "they", "this", "that", "with", "from", "will",
    "would", "there", "their", "what", "about", "which", "when", "make", "like", "time", "just",
    "know", "take", "into", "year", "your", "some", "could", "them", "other", "than", "then",
]

# Retrieval stop words.
RETRIEVAL_STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "as", "is", "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare",
    "ought", "used", "it", "its", "this", "that", "these", "those", "i", "you", "he", "she", "we",
    "they", "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "also",
]

# Sentiment words (token-count and distinct-word variants).
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "happy", "joy",
    "positive", "best", "perfect", "beautiful", "awesome", "brilliant", "outstanding", "superb",
    "delightful", "pleasant", "nice",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "hate", "worst", "poor", "sad", "negative", "ugly",
    "disappointing", "frustrating", "annoying", "boring", "dreadful", "disgusting", "unpleasant",
    "painful", "miserable", "angry",
]
POSITIVE_WORDS_SHORT = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "happy", "best",
    "perfect", "beautiful", "awesome",
]
NEGATIVE_WORDS_SHORT = [
    "bad", "terrible", "awful", "horrible", "hate", "worst", "poor", "disappointing", "sad",
    "angry", "ugly", "boring",
]

# Linguistic markers.
NEGATION_WORDS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nowhere", "hardly",
]
INTENSIFIERS = [
    "very", "extremely", "absolutely", "completely", "totally", "really", "so", "too",
]

# Platform codes of cluster ids.
PLATFORM_CODES = {
    "sms": "SMS", "imessage": "IMSG", "facebook": "FB", "messenger": "FB", "email": "MAIL",
    "chatgpt": "CHAT", "whatsapp": "WA", "discord": "DISC", "snapchat": "SNAP",
}

# Topic keywords in lookup order (protected-person terms come from the caller).
TOPICS = [
    ("daughter", "CHILD"), ("child", "CHILD"), ("baby", "CHILD"), ("kid", "CHILD"),
    ("visits", "VISITS"), ("visitation", "VISITS"), ("parenting time", "VISITS"),
    ("custody", "VISITS"), ("calls", "CALLS"), ("phone", "CALLS"), ("call", "CALLS"),
    ("school", "SCHOOL"), ("education", "SCHOOL"), ("teacher", "SCHOOL"), ("money", "MONEY"),
    ("financial", "MONEY"), ("bills", "MONEY"), ("rent", "MONEY"), ("health", "HEALTH"),
    ("medical", "HEALTH"), ("doctor", "HEALTH"), ("hospital", "HEALTH"), ("substance", "SUBST"),
    ("alcohol", "SUBST"), ("drugs", "SUBST"), ("adderall", "SUBST"), ("infidelity", "INFID"),
    ("cheating", "INFID"), ("affair", "INFID"), ("threat", "THREAT"), ("threaten", "THREAT"),
    ("hurt", "THREAT"), ("kill", "THREAT"),
]

# Canonical message fields and their aliases, in resolution order.
FIELD_ALIASES = {
    "body": ["body", "text", "message", "content", "msg", "sms_body", "messageBody"],
    "date": ["date", "timestamp", "time", "datetime", "sent_at", "created_at", "sentAt", "createdAt"],
    "readableDate": ["readable_date", "readableDate", "formatted_date", "formattedDate", "dateString"],
    "contactName": ["contact_name", "contactName", "sender", "from", "name", "author", "displayName"],
    "address": ["address", "phone", "number", "phone_number", "phoneNumber", "tel", "recipient"],
    "messageType": ["type", "messageType", "message_type", "direction", "msgType"],
}

# Timestamp notations searched for in free text, in priority order.
TIMESTAMP_NOTATIONS = [
    r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})",
    r"(\d{2}\/\d{2}\/\d{4} \d{2}:\d{2})",
    r"(\d{4}\/\d{2}\/\d{2} \d{2}:\d{2})",
    r'"date":\s*"([^"]+)"',
    r'"readable_date":\s*"([^"]+)"',
    r'"readableDate":\s*"([^"]+)"',
    r'"timestamp":\s*"?(\d+)"?',
]
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm a", "MMM d, yyyy", "MM/dd/yyyy HH:mm",
    "M/d/yyyy h:mm a", "yyyy/MM/dd HH:mm",
]

# Statutory factor letters.
FACTORS = [
    ("a", "Love, Affection, and Emotional Ties"), ("b", "Capacity to Continue Education"),
    ("c", "Capacity to Provide"), ("d", "Length of Time in Environment"),
    ("e", "Permanence of Family Unit"), ("f", "Moral Fitness"),
    ("g", "Mental and Physical Health"), ("h", "Home, School, and Community Record"),
    ("i", "Reasonable Preference of Child"), ("j", "Domestic Violence"),
    ("k", "Willingness to Facilitate Relationship"), ("l", "Other Factors"),
]

# Codes and names of the offensive-lexicon categories.
LEXICON_CATEGORIES = [
    ("PS", "Negative Stereotypes - Ethnic Slurs"), ("RCI", "Locations & Demonyms"),
    ("PA", "Professions & Occupations"), ("DDF", "Physical Disabilities & Diversity"),
    ("DDP", "Cognitive Disabilities & Diversity"), ("DMC", "Moral & Behavioral Defects"),
    ("IS", "Words Related to Social & Economic Disadvantage"), ("OR", "Plants"),
    ("AN", "Animals"), ("ASM", "Male Genitalia"), ("ASF", "Female Genitalia"),
    ("PR", "Prostitution"), ("OM", "Homosexuality (Male)"), ("QAS", "Homosexuality (Generic)"),
    ("CDS", "Derogatory Words"), ("RE", "Felonies & Related Words"),
    ("SVP", "Words Related to Prostitution"),
]

# Marker vocabularies of the statistical language markers.
FIRST_PERSON = ["i", "me", "my", "mine", "myself"]
SECOND_PERSON = ["you", "your", "yours", "yourself"]
CERTAINTY_WORDS = [
    "always", "never", "nothing", "everything", "everyone", "nobody", "fact", "obviously",
    "clearly", "literally",
]
HEDGE_WORDS = [
    "maybe", "perhaps", "possibly", "might", "could", "i think", "i guess", "sort of", "kind of",
    "probably",
]
OVERELABORATION = {
    "location_reporting": [
        "i'm at", "i'm still at", "i'm heading to", "i'll be at", "i'm on my way to",
        "i just left", "i just arrived at",
    ],
    "time_reporting": [
        "i left at", "i'll be back by", "i've been here since", "i'll be done in",
    ],
    "justification": [
        "i'm doing this because", "i had to", "i needed to", "the reason is", "i'm just",
        "i was just",
    ],
    "pre_emptive": [
        "before you ask", "i know you're wondering", "just so you know", "for the record",
        "to be clear",
    ],
}

# Mime types of custody records.
MIME_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html",
    "xml": "application/xml", "json": "application/json", "csv": "text/csv",
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "mp4": "video/mp4", "mp3": "audio/mpeg",
}


def builtin_lexicon(spark: SparkSession) -> DataFrame:
    """The built-in phrases with the weight, polarity and factors of their module."""
    rows = [
        (m, name, phrase, polarity, weight, factors)
        for m, name, polarity, _group, weight, factors in MODULES
        for phrase in PHRASES.get(m, [])
    ]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def term_lexicon(
    spark: SparkSession, terms: dict[str, list[str]], category: str = "negative", severity: int = 50
) -> DataFrame:
    """Lexicon from plain ``module -> terms`` lists."""
    rows = [(m, m, t, category, severity, []) for m, ts in terms.items() for t in ts]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)
