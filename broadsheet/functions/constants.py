"""Fixed values of the news engine: word lists, tables, patterns and thresholds. They are given by the format and the
editorial rules, and results depend on each of them."""

from __future__ import annotations

# Words a headline can carry without saying what it is about.
TITLE_STOP_WORDS = """
a about according after all also amid an and any are as at be been being both but by can could did do does for from had
has have he her here him his how i if in into is it its just may more most new now of off on once one only onto or other
our out over said says she should so some such tells than that the their them then there these they this those through to
under up upon us via was we were what when where which while who whom why will with would you your
""".split()

# Words that the editorial similarity rules leave out.
EDITORIAL_STOP_WORDS = """
about after against also and are been before but for from has have her his into its more most not over said says than
that the their them then there these they this those under was were what when which while who will with would
""".split()

# Words that start a sentence rather than a name.
COMMON_INITIAL_WORDS = """
a an the in on at to for from with by as is are was were it its this that these those according officials sources however
meanwhile additionally furthermore under after before during following earlier reportedly notably moreover upgrades
launches announces reports states confirms reveals adds expands second new first
""".split()

# Leading labels and trailing publishers of headlines.
LEADING_LABELS = [
    r"^(?:live(?:\s+updates)?|breaking(?:\s+news)?|watch|opinion|analysis|explainer|exclusive|fact\s+check|editorial|report|video)\s*[:-]\s*",
    r"^\[(?:live|video|audio|watch|photos?|explainer|opinion|analysis|editorial|exclusive|fact\s+check)\]\s*[:-]?\s*",
]
TRAILING_PUBLISHERS = (
    r"\s*(?:[-–—|/]\s*(?:The\s+Hindu|NDTV|Indian\s+Express|Hindustan\s+Times|Times\s+of\s+India|Mint|Scroll|The\s+Wire|"
    r"BBC(?:\s+News)?|Reuters|PTI|ANI|LiveMint|Business\s+Standard|India\s+Today|Financial\s+Express|Moneycontrol|News18|"
    r"Zee\s+News|ABP\s+News|Deccan\s+Herald|The\s+Print|Firstpost|Economic\s+Times))+\s*$"
)

# Query parameters that only track, besides those that start with utm_.
TRACKING_PARAMETERS = "dclid fbclid gclid igshid li_fat_id mc_cid mc_eid msclkid s_cid ttclid twclid vero_id yclid".split()

# The named character references that feeds are decoded by.
NAMED_ENTITIES = {
    "amp": "&", "apos": "'", "bull": "•", "copy": "©", "deg": "°", "divide": "÷", "euro": "€", "gt": ">", "hellip": "…",
    "ldquo": "“", "lt": "<", "lsaquo": "‹", "lsquo": "‘", "mdash": "—", "middot": "·", "nbsp": " ", "ndash": "–",
    "not": "¬", "para": "¶", "plusmn": "±", "pound": "£", "quot": '"', "raquo": "»", "rdquo": "”", "reg": "®",
    "rsaquo": "›", "rsquo": "’", "shy": "­", "times": "×", "trade": "™", "yen": "¥",
}

# Numbers spelled out.
SPELLED_NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15",
    "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30",
    "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100",
    "thousand": "1000", "lakh": "100000", "million": "1000000", "crore": "10000000", "billion": "1000000000",
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5",
}
MONTHS = """
january february march april may june july august september october november december
jan feb mar apr jun jul aug sep sept oct nov dec
""".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
RELATIVE_DATES = ["yesterday", "today", "tomorrow", "tonight", "last week"]

# Words that place a story in India.
INDIA_TERMS = [
    *"india indian delhi mumbai bengaluru bangalore chennai kolkata hyderabad pune ahmedabad rbi isro sebi cbi parliament".split(),
    "lok sabha", "rajya sabha", "supreme court", "high court",
    *"modi rupee sensex nifty crore lakh bjp congress maharashtra karnataka".split(),
    "tamil nadu", "kerala", "gujarat", "punjab", "bengal", "uttar pradesh", "bihar", "rajasthan", "kashmir", "ladakh", "assam", "odisha",
]

# Keywords of topics; the order of topics breaks ties.
TOPIC_KEYWORDS = {
    "business-economy": """sensex nifty market markets inflation gdp rbi repo rate stocks shares bank banks banking fiscal
        trade tax gst rupee startup investment profit revenue economy economic bse nse gold crude sebi""".split(),
    "science-health-climate": """isro space satellite nasa health disease vaccine hospital medical virus climate weather
        cyclone monsoon pollution emission species environment cancer aiims research scientists drdo""".split(),
    "technology-ai": """ai software chip chips semiconductor cyber hacker google microsoft apple openai tech technology
        smartphone app telecom 5g computing robotics meta""".split(),
    "sports": """cricket bcci ipl test match football fifa olympics badminton tennis hockey chess medal tournament
        championship wrestler wrestling goal""".split(),
    "culture-entertainment": """film movie cinema actor actress bollywood hollywood music artist art museum festival dance
        theatre book literature award awards oscar ott""".split(),
    "policy-geopolitics": """summit treaty diplomacy bilateral foreign embassy sanctions nato geopolitics war conflict
        border security pact accord g20 brics""".split(),
    "india": ["parliament", "lok sabha", "rajya sabha", "supreme court", "high court", "cabinet", "bjp", "congress", "election", "delhi", "mumbai", "police", "cm", "governor", "bill", "act", "scheme", "modi"],
    "world": "global international un us china russia ukraine europe asia president".split(),
}
TOPIC_WEIGHTS = {
    "india": 1.0, "policy-geopolitics": 0.9, "business-economy": 0.85, "science-health-climate": 0.85,
    "technology-ai": 0.8, "world": 0.75, "sports": 0.65, "culture-entertainment": 0.6,
}
INTEREST_TOPICS = ["business-economy", "science-health-climate", "technology-ai", "sports", "culture-entertainment", "policy-geopolitics"]

# Terms of hard news, singular.
HARD_NEWS_TERMS = [
    "air strike", "airstrike", "artillery", "bombardment", "casualties", "ceasefire", "combat", "drone strike", "front line",
    "insurgency", "invasion", "militant", "missile", "offensive", "shelling", "troops", "war", "warfare",
    "abduction", "arrest", "assault", "homicide", "indictment", "kidnapping", "manslaughter", "murder", "robbery", "shooting",
    "stabbing", "trafficking",
    "cyclone", "derailment", "drought", "earthquake", "evacuation", "explosion", "famine", "flood", "flooding", "landslide",
    "stampede", "tsunami", "wildfire",
    "boycott", "censure", "coup", "crackdown", "defection", "impeachment", "no confidence", "protest", "purge", "sanctions",
    "standoff", "ultimatum", "walkout",
]
MARKUP = [r"</?[a-zA-Z][^<>]*>", r"<!(?:--|[a-zA-Z])", r"&[a-zA-Z][a-zA-Z0-9]{1,31};", r"&#(?:\d+|[xX][0-9a-fA-F]+);"]

# Address ranges that are not the public internet; the first that matches decides.
IPV4_RANGES = [
    ("255.255.255.255", 32, "broadcast"), ("0.0.0.0", 8, "unspecified"), ("10.0.0.0", 8, "private"),
    ("100.64.0.0", 10, "shared"), ("127.0.0.0", 8, "loopback"), ("169.254.0.0", 16, "link-local"),
    ("172.16.0.0", 12, "private"), ("192.0.0.0", 24, "reserved"), ("192.0.2.0", 24, "documentation"),
    ("192.88.99.0", 24, "reserved"), ("192.168.0.0", 16, "private"), ("198.18.0.0", 15, "benchmarking"),
    ("198.51.100.0", 24, "documentation"), ("203.0.113.0", 24, "documentation"), ("224.0.0.0", 4, "multicast"),
    ("240.0.0.0", 4, "reserved"),
]
IPV6_RANGES = [
    ("64:ff9b::", 96, "reserved"), ("64:ff9b:1::", 48, "reserved"), ("100::", 64, "reserved"),
    ("2001:db8::", 32, "documentation"), ("2001:10::", 28, "reserved"), ("2001:20::", 28, "reserved"),
    ("2001::", 32, "reserved"), ("2002::", 16, "reserved"), ("5f00::", 16, "reserved"), ("fc00::", 7, "unique-local"),
    ("fe80::", 10, "link-local"), ("fec0::", 10, "reserved"), ("ff00::", 8, "multicast"),
]
PRIVATE_SUFFIXES = [".localhost", ".local", ".internal", ".home.arpa"]
RESERVED_TLDS = ["invalid", "test", "example"]
RESERVED_DOMAINS = ["example.com", "example.net", "example.org"]

# Caps, windows and thresholds.
TITLE_CAP, DESCRIPTION_CAP, AUTHOR_CAP = 300, 4000, 200
NEAR_HOURS, NEAR_SCORE, NEAR_TOKENS = 72, 0.48, 2
UNIGRAM_SHARE, BIGRAM_SHARE, UNIGRAM_FLOOR, NUMBER_PENALTY = 0.7, 0.3, 0.9, 0.5
CLUSTER_SIZE, CLUSTER_HOURS, MEMBER_FLOOR, SEMANTIC_FLOOR = 20, 72, 0.45, 0.8
HALF_LIFE_HOURS, PENALTY_SHARE = 18.0, 0.5
CORE_STORIES, PER_TOPIC, PER_PUBLISHER, POOL_STORIES, PIPELINE_POOL = 8, 3, 2, 4, 3
FEATURE_WEIGHTS = {"recency": 0.25, "corroboration": 0.25, "source_tier": 0.15, "india_relevance": 0.20, "topic_weight": 0.15}
WORDS_PER_MINUTE = 220
MIN_PUBLISHERS = 6
MAX_DECK_WORDS, MAX_PARAGRAPH_WORDS, MAX_WHY_WORDS = 30, 90, 80
SHARED_SOURCES, SHARED_SHARE, HEADLINE_DICE, SLUG_WORDS, SLUG_JACCARD = 2, 0.5, 0.4, 2, 0.5
SLOW_MS, STALE_HOURS = 5000, 72
KEPT_EDITIONS, KEPT_INTERESTS, POOLED_VISIBLE = 30, 2, 2
EDITORIAL_ZONE = "Asia/Kolkata"
