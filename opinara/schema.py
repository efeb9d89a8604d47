"""Fixed values of review analytics: word lists, thresholds, taxonomies. Stated here once."""

# fixed values: thresholds of trends, lifecycle and escalation
Z_ANOMALY, EMERGING_RATIO, EMERGING_POINTS = 2.5, 2.0, 10.0
BASELINE_RATE, SIGNIFICANT_POINTS, SYSTEMIC_RUN, PERSISTENT_WINDOWS, SYSTEMIC_FACTOR = 5.0, 5.0, 2, 3, 2.0
PRIORITY_WEIGHTS = {"severity": 0.30, "velocity": 0.25, "frequency": 0.20, "confidence": 0.15, "reach": 0.07, "recency": 0.03}
PRIORITY_LEVELS = (("critical", 80), ("high", 60), ("medium", 40), ("low", 0))
STAGE_SEVERITY = {"resolved": 0, "resolving": 20, "detected": 40, "growing": 60, "systemic": 80, "persistent": 100}
SENSITIVITY, REVENUE_PER_STAR = 0.08, 0.12
DUPLICATE_SIMILARITY, MIN_REVIEW_LENGTH = 0.85, 10

# fixed values: word lists
PRODUCT_TERMS = ["buy", "purchased", "product", "quality", "packaging", "delivery", "price", "item", "money", "worth"]
PERSONAL_TERMS = ["i", "my", "me", "bought", "mine", "we", "our"]
HINDI_WORDS = [
    "hai", "bhi", "ki", "se", "ko", "aur", "nahi", "bahut", "accha", "acha", "sab", "kya", "hain", "mein", "ho", "gaya", "tha", "thi", "hua", "kuch",
    "ab", "toh", "tum", "main", "mujhe", "mera", "meri", "he", "ye", "yeh", "wo", "woh", "bahi", "bhai", "yaar", "mast", "bakwas", "bekar", "kharab",
    "theek", "karo", "kar", "raha", "rahi", "ka", "ke", "pas", "paas",
]
ABBREVIATIONS = {
    "gr8": "great", "pls": "please", "bcz": "because", "nahi": "not", "bahut": "very", "accha": "good", "acha": "good",
    "bakwas": "nonsense/bad", "mast": "excellent", "kharab": "bad/broken", "theek": "okay",
}
EMOJI_TAGS = {"😡": "[ANGRY]", "🔥": "[EXCELLENT]", "💔": "[DISAPPOINTED]", "👍": "[POSITIVE]", "😍": "[LOVE]", "🤬": "[FURIOUS]", "😤": "[FRUSTRATED]"}
NEGATIVE_WORDS = ["worst", "terrible", "awful", "horrible", "useless", "waste", "pathetic", "broken", "scam", "fraud", "bakwas", "bekar", "ghatiya", "poor", "bad", "disappointed", "angry", "disgusting", "refund", "hate"]
POSITIVE_WORDS = ["amazing", "excellent", "great", "love", "perfect", "fantastic", "outstanding", "wonderful", "best", "superb", "recommended", "happy", "good", "nice", "mast", "zabardast"]
BOT_NEGATIVE = ["bad", "worst", "broken", "terrible", "waste", "fraud", "fake", "pathetic"]
BOT_POSITIVE = ["amazing", "excellent", "great", "love", "perfect", "fantastic", "best"]
BOT_GENERIC = ["amazing", "great", "good", "quality", "recommend", "everyone", "value", "money", "best", "purchase", "excellent"]
BOT_SPECIFIC = ["buy", "delivery", "battery", "price", "item", "support", "worked", "broke", "arrived", "packaging"]
BATCH_KEYWORDS = ["battery", "packaging", "delivery", "quality", "price", "service", "screen", "camera", "speed", "design", "support", "cap", "leak", "material"]
COMPLAINT_KEYWORDS = ["packaging", "battery", "delivery", "quality", "price", "service", "cap", "leak", "defect", "broken", "damaged"]
HEATMAP_FEATURES = ["battery", "packaging", "delivery", "durability", "support", "ease_of_use", "taste", "price"]
FEATURE_TAXONOMY = {
    "Electronics": ["battery", "durability", "charging", "performance", "packaging", "price"],
    "Personal Care": ["packaging", "texture", "scent", "effectiveness", "ingredients", "price"],
    "Food": ["taste", "freshness", "packaging", "ingredients", "value", "texture"],
}

# function words by which English is told; our own choice
ENGLISH_WORDS = ["the", "and", "is", "was", "of", "to", "in", "it", "this", "that", "for", "with", "not", "are", "but", "my", "i", "very"]

# fixed values: emotions, from the most negative; (name, weight, urgency, lowest score, highest score, signals)
EMOTIONS = [
    ("furious", 25, "escalate", 0, 4, ["WORST", "NEVER AGAIN", "SCAM", "FRAUD", "GARBAGE", "DEMANDING REFUND", "WILL POST EVERYWHERE", "LEGAL ACTION", "CONSUMER COURT", "NEVER BUYING", "COMPLETE SCAM", "TOTAL FRAUD", "RUINED", "DESTROYED", "🤬", "💀", "☠️", "🖕", "BILKUL BAKWAS", "SABSE GHATIYA", "PAISA BARBAD", "DHOKA", "LOOT", "FRAUD HAI"]),
    ("angry", 15, "critical", 5, 14, ["terrible", "pathetic", "useless", "waste", "horrible", "disgusting", "awful", "dreadful", "abysmal", "worst ever", "unacceptable", "defective", "broken", "ruined", "😡", "👎", "🤮", "bakwas", "bekar", "ghatiya", "kachra", "faltu", "bilkul bekar", "total waste", "paisa waste"]),
    ("frustrated", 12, "high", 15, 29, ["annoying", "keeps failing", "again and again", "still not fixed", "same issue", "repeated problem", "fed up", "tired of", "not working properly", "inconsistent", "unreliable", "😤", "😩", "🤦", "phir se", "baar baar", "thak gaya", "kab theek hoga", "kaam nahi karta", "problem hai"]),
    ("disappointed", 10, "medium", 30, 44, ["expected better", "not satisfied", "below par", "could be better", "not worth", "disappointed", "let down", "underwhelming", "not as described", "misleading", "overrated", "😟", "😔", "😞", "umeed se kam", "theek nahi", "jaise socha tha waisa nahi", "pehle waala better tha"]),
    ("neutral", 8, "low", 45, 69, ["okay", "average", "fine", "normal", "standard", "nothing special", "as expected", "mediocre", "theek thaak", "chalta hai", "normal hai"]),
    ("satisfied", 10, "none", 70, 84, ["good", "works well", "decent", "nice", "okay", "satisfactory", "fine", "meets expectations", "worth the price", "recommended", "👍", "🙂", "✅", "acha hai", "theek hai", "chalta hai", "sahi hai", "value for money"]),
    ("delighted", 15, "none", 85, 100, ["amazing", "love it", "fantastic", "incredible", "perfect", "outstanding", "exceeded expectations", "best ever", "brilliant", "phenomenal", "blown away", "absolutely love", "😍", "🤩", "❤️", "🔥", "💯", "⭐", "zabardast", "mast", "ekdum mast", "shandaar", "jhakaas", "kamaal", "bahut acha", "best hai"]),
]
SENTIMENT_EMOTION = {"positive": "satisfied", "negative": "disappointed", "mixed": "neutral", "neutral": "neutral"}

# fixed values: sarcasm rules (flag, pattern, weight)
SARCASM_RULES = [
    ("quoted_positive_words", r"""(?i)["'](?:great|amazing|excellent|fantastic|wonderful|perfect|awesome|best|love|nice)["']""", 0.3),
    ("excessive_punctuation", r"[!?]{3,}|[!?.]{4,}", 0.2),
    ("contradictory_intensifier", r"(?i)\b(?:amazingly|incredibly|absolutely|totally|completely|really|so|such)\s+(?:terrible|awful|bad|worst|horrible|useless|waste|pathetic)", 0.35),
    ("sarcasm_markers", r"(?i)\b(?:yeah right|sure|obviously|clearly|totally|definitely|as if|like i care|tell me about it|oh great|just what i needed)", 0.3),
    ("shouting_positive_caps", r"\b(?:GREAT|AMAZING|EXCELLENT|FANTASTIC|PERFECT|AWESOME|LOVE IT)\b", 0.25),
    ("positive_but_negative_context", r"(?i)\b(?:great|amazing|good)\b.*?(?:but|except|however|although|though).*?(?:bad|terrible|problem|issue)", 0.2),
]

# fixed values: actions of each team at each stage
TEAM_ACTIONS = {
    "detected": {"Quality": ["Monitor for pattern confirmation", "Prepare investigation protocol"], "Marketing": ["Pause related feature promotions", "Prepare holding statement"], "Support": ["Update FAQ with known workaround", "Brief support team"], "Operations": ["Check inventory for affected batches", "Review supplier reports"]},
    "growing": {"Quality": ["Initiate root cause analysis", "Accelerate lab testing"], "Marketing": ["Suspend affected campaigns", "Prepare customer communication"], "Support": ["Escalate handling procedures", "Create specialized ticket queue"], "Operations": ["Quarantine suspect inventory", "Notify logistics partners"]},
    "systemic": {"Quality": ["Immediate production halt for affected lines", "Emergency recall assessment"], "Marketing": ["Halt all product advertising immediately", "Prepare crisis communication"], "Support": ["Activate crisis response team", "Prepare for 10x ticket volume"], "Operations": ["Emergency supply chain audit", "Prepare recall logistics"]},
    "persistent": {"Quality": ["Complete redesign of affected component", "Implement new QC protocols"], "Marketing": ["Long-term reputation recovery planning", "Transparent customer updates"], "Support": ["Permanent process changes", "Enhanced compensation authority"], "Operations": ["Supplier replacement program", "Process overhaul"]},
    "resolving": {"Quality": ["Verify fix effectiveness", "Monitor for regression"], "Marketing": ["Prepare relaunch campaign", "Gather positive testimonials"], "Support": ["Close ticket backlog", "Follow up with affected customers"], "Operations": ["Resume normal operations", "Audit fix deployment"]},
}

# fixed values: words that carry no meaning of their own in a phrase, and words of any product
PHRASE_STOP_WORDS = [
    "the", "a", "an", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
    "and", "or", "but", "so", "yet", "for", "nor", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "must", "shall",
    "very", "really", "quite", "pretty", "too", "just", "only", "even", "also", "still", "already", "here", "there", "now", "then", "today", "tomorrow", "good", "bad", "nice", "great", "okay", "fine",
    "thing", "things", "stuff", "something", "anything", "one", "two", "first", "second", "way", "ways", "time", "times", "day", "days", "lot", "lots", "bit", "piece", "part", "parts", "kind", "sort",
]
PHRASE_PRODUCT_WORDS = ["product", "item", "order", "delivery", "package", "box", "amazon", "flipkart", "seller", "company", "brand"]

# fixed values: labels of campaigns by confidence, and the summary of each kind after its number of members
CAMPAIGN_LABEL, LOOSE_CAMPAIGN_LABEL = "HIGH PROBABILITY COORDINATED ATTACK", "SUSPICIOUS CLUSTER"
CAMPAIGN_SUMMARIES = {
    "TIMESTAMP_BURST": "reviews submitted identically within 2 hours.",
    "USERNAME_PATTERN": "sequential usernames detected.",
    "TEXT_SIMILARITY": "functionally identical reviews found.",
}
# fixed values: colours of network nodes
CAMPAIGN_COLOR, LOOSE_CAMPAIGN_COLOR = "#F44336", "#FF9800"
STATUS_COLORS = {"CONFIRMED_BOT": "#F44336", "HIGH_SUSPICION": "#FF9800", "LOW_SUSPICION": "#FFEB3B", "TRUSTED": "#4CAF50"}

# fixed values: categories of replies by words in the feature, their teams, and the reply of each tone
REPLY_CATEGORIES = [("packaging", ["packaging", "pack", "seal", "leak", "cap"]), ("quality", ["quality", "build", "defect", "broken"]), ("delivery", ["delivery", "shipping", "transit"])]
REPLY_TEAMS = {"packaging": "packaging team", "quality": "quality team", "delivery": "logistics team", "default": "support team"}
REPLIES = {
    "professional": {
        "packaging": "Dear Customer, We sincerely apologize for the packaging issue you experienced with {product}. We take quality control very seriously and have flagged this with our QA team for immediate investigation. A replacement will be shipped within 2 business days. Reference: {ref_id}.",
        "quality": "Dear Customer, Thank you for reporting this quality concern with {product}. We have escalated this to our manufacturing team for root cause analysis. Please contact support@brand.com with your order ID for a priority replacement. We value your feedback.",
        "delivery": "Dear Customer, We regret the delivery experience with {product}. Our logistics partner has been notified and we're implementing additional quality checks. A refund/replacement has been initiated. Expected resolution: 3 business days.",
        "default": "Dear Customer, We appreciate your feedback regarding {product} and sincerely apologize for the {issue} you experienced. Our team is actively addressing this concern. Please reach out to us at support@brand.com for immediate resolution. Reference: {ref_id}.",
    },
    "empathetic": {
        "packaging": "Hi there, I'm really sorry about the packaging issue with your {product} — I completely understand how frustrating that must be, especially when you're excited about a new product. We've already flagged this with our packaging team and I've personally arranged a replacement for you. You should receive it within 2 days. 🙏",
        "quality": "Hi, I hear you and I'm truly sorry about the quality issue with {product}. That's not the experience we want for our customers. I've personally escalated this and our team is looking into it right away. Let me make this right — we're sending you a replacement immediately.",
        "delivery": "Hi! I'm so sorry about the delivery problem with your {product}. I can imagine how disappointing that was. We've spoken to our delivery partner about this and I'm personally ensuring your replacement reaches you quickly. Thank you for your patience! 💛",
        "default": "Hi there, I'm genuinely sorry about what happened with your {product}. Your experience with {issue} is completely unacceptable and I want to make it right. I've already escalated this to our team. Please let me know how I can help — we truly value you as a customer. 🙏",
    },
    "action_focused": {
        "packaging": "Issue noted: {product} packaging defect. Action taken: ✅ Replacement shipped (tracking in 4 hrs) ✅ QA alert raised with packaging line ✅ Full refund if replacement unsatisfactory. Contact: support@brand.com | Ref: {ref_id}",
        "quality": "Issue noted: {product} quality concern. Immediate actions: ✅ Replacement dispatched today ✅ Quality audit initiated for this batch ✅ Your case escalated to senior QA lead. Timeline: Resolution within 48 hours. Contact: {ref_id}",
        "delivery": "Issue noted: {product} delivery problem. Steps taken: ✅ Delivery partner notified ✅ Re-delivery scheduled within 24 hours ✅ Compensation credit applied to your account. Track progress: support@brand.com | {ref_id}",
        "default": "Issue noted: {product} – {issue}. Immediate actions: ✅ Case escalated to {team} ✅ Resolution timeline: 48 hours ✅ Replacement/refund initiated. Contact: support@brand.com | Ref: {ref_id}",
    },
}

# fixed values: what to do about an anomaly and what it means, by its type
ANOMALY_TEXTS = {
    "RATING CRASH": ("Review recent product changes and halt immediate marketing spend.", "Rating dropped significantly below historical norms indicating potential broken update or bad batch."),
    "COMPLAINT SPIKE": ("Investigate recent negative reviews immediately.", "Complaints spiked drastically above normal baseline."),
    "SILENT COMPLAINT GROWTH": ("Preemptively catch the structural issue before rating drops further.", "Continuous long-term rise in complaints detected across 3 weeks."),
    "VOLUME SPIKE with LOW RATING": ("Check social media for viral complaints or coordinated actions.", "Immediate influx of negative reviews detected."),
}
ANOMALY_DEFAULT = ("Monitor closely.", "Statistical anomaly detected.")
FEATURE_SPIKE_TEXTS = ("Audit {feature} issues immediately.", "{feature} complaints are heavily spiking above normal baseline.")

# fixed values: advice of each priority level, by the driving factor, and its urgency
RECOMMENDATIONS = {
    "critical": ["Immediate action required: High-severity systemic issue", "Immediate action required: Rapidly escalating issue", "Immediate action required: Widespread customer impact"],
    "high": ["Urgent attention: Issue affecting significant customer base", "Urgent attention: Issue showing strong growth trend", "Prioritize: Issue with substantial customer impact"],
    "medium": ["Monitor closely: Issue showing growth potential", "Monitor: Issue with moderate customer impact"],
    "low": ["Track: Low priority issue, continue monitoring"],
}
LEVEL_URGENCY = {"critical": "immediate", "high": "urgent", "medium": "planned", "low": "track"}

# fixed values: team cards and things not to do
CARD_TEXTS = {
    "quality": [(["packaging", "cap", "leak"], "Audit cap/seal on production line immediately"), (["battery", "defect", "broken"], "Check firmware version and battery supplier batch"), (["delivery", "service"], "Review fulfillment SLA with logistics partner")],
    "quality_other": "Investigate top complaint feature: ", "quality_none": "Review quality assurance processes",
    "marketing_packaging": "Pause all packaging-focused ad campaigns", "marketing_other": "Avoid promoting features currently under complaint", "marketing_none": "Review current marketing messaging",
}
DO_NOT_DO = ["Do not close complaints without root cause confirmation", "Do not run discount campaigns while defect is unresolved"]
DO_NOT_DO_BOTS = "Do not respond to flagged bot reviews publicly"

# fixed values: rules of categories by words in the product name, for each caller; else General
CATEGORY_RULES = {
    "service": [("Personal Care", ["bottle", "care"]), ("Electronics", ["charge", "electronics"]), ("Food", ["mix", "blend"])],
    "batch": [("Personal Care", ["bottle", "care"]), ("Electronics", ["charge", "bolt"]), ("Food", ["mix", "blend", "nutri"])],
    "evaluation": [("Personal Care", ["bottle"]), ("Electronics", ["charge"]), ("Food", ["mix"])],
}
# fixed values: words by which columns are recognised in a preview, the first column of each kind
PREVIEW_COLUMNS = {
    "review": ["review", "text", "comment", "feedback", "body", "content"], "rating": ["rating", "stars", "score", "rate"], "product": ["product", "product_name", "item", "name", "title"],
    "date": ["date", "timestamp", "created", "time", "posted"], "username": ["user", "username", "reviewer", "author", "name"],
}
# fixed values: target column and the substrings that name it, in order of precedence
COLUMN_WORDS = (
    ("review_text", ("review", "text", "comment", "feedback", "body", "content", "description", "message")),
    ("rating", ("rating", "star", "score", "stars")),
    ("product_name", ("product", "item", "brand", "category")),
    ("timestamp", ("date", "time", "timestamp", "created", "posted")),
    ("username", ("user", "author", "reviewer", "username")),
)
ISSUE_KEYWORDS = ["packaging", "battery", "delivery", "quality", "price", "service", "cap", "leak"]
TOO_FEW_WEEKS = "Need more data — 4+ weeks required for anomaly detection."
MISSING_RESULT = "Missing in API response"
NO_JSON, NO_RESULTS = "JSON parse error", "Parse error: Invalid JSON structure: missing 'results' array"
