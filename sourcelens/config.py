"""Thresholds, weights, lists and patterns that results depend on."""

# Results must agree on them.
POSITION_WEIGHTS = (1.0, 0.62, 0.38, 0.22, 0.15)
LATER_WEIGHT = 0.1
DOMINANCE_ALERT = 0.60
SIMILARITY_CLUSTER, SIMILARITY_LEAST, SIMILARITY_COPY = 0.45, 0.35, 0.55
PERSISTENCE_DAYS = 7
FRONT_WINDOW_WORDS, FRONT_LEAST_WORDS = 200, 40
CHUNK_MIN_WORDS, CHUNK_MAX_WORDS = 30, 400
AUTHORITY_FLAG, COMPARATIVE_FLAG, HEDGING_FLAG = 0.35, 0.35, 0.2
THIN_WORDS = 80
TRUST_ENDORSEMENT_MIN = 0.62
ENDORSEMENT_BLOCK, ENDORSEMENT_DOWNRANK = 0.5, 0.2
CONVERGENCE_HOSTS = 3

# Patterns counted in lower-case text.
AUTHORITY = [r"\baccording to\b", r"\bexperts?\b", r"\bdr\.?\s+\w+", r"\binstitute\b", r"\bclinical\b", r"\bevidence shows\b", r"\bas noted in\b", r"\bstud(y|ies)\b", r"\d{1,3}%\b"]
COMPARATIVE = [r"\bbest\b", r"\boutperforms?\b", r"\bsuperior\b", r"\bcompared to\b", r"\bbreakthrough\b", r"\b#1\b", r"\bleading\b"]
TEMPORAL = [r"\b20\d{2}\b", r"\blatest\b", r"\bnew\b"]
PURPOSE = [r"\brecommend\b", r"\bshould\b", r"\bmost practical\b"]
HEDGES = [r"\bdepends on\b", r"\bmay\b", r"\bcan help\b", r"\bno proven cure\b", r"\bconsult\b", r"\bnone is universally\b"]
ALTERNATIVES = r"\b(options include|alternatives include|include trello|include asana|such as trello|compared to| versus | vs\.|no single app is universally best|everyone has a different workflow|none is universally)\b"
MEDICAL_CLAIM = r"\b(cure[ds]?|remission)\b"
WANTS_RECOMMENDATION = r"\b(best|recommend|should i|top \d|compare|vs\.?|versus)\b"
ENDORSES = r"\b(the best|you should|recommend|go with|breakthrough|widely regarded|outperforms?)\b"


# Quoted speech in the text as it stands, ten hits a word.
QUOTES = [r'"[^"]{15,}"', r"'[^']{15,}'", r"\bstates:\s*['\"]", r"(?i)\baccording to [A-Z][^.,;\n]{2,50}"]
QUOTES_FLAG = 0.25
QUERY_STOPWORDS = ["a", "an", "the", "is", "are", "what", "how", "for", "to", "of", "in", "on"]

# A brand placed in a personal story; looked for in lower-case text.
PLANT_LEAST_WORDS = 25
NARRATIVE = (
    r"\b(my (?:dad|mom|father|mother|girlfriend|boyfriend|husband|wife|partner|friends?)|i (?:got|gave|bought|wear|love|dont|don't|wasn't|wasnt|genuinely)|"
    r"(?:for|on) (?:his|her|my) (?:birthday|anniversary|father'?s day)|every day|still (?:holding|thinking))\b"
)
CONSUMER = (
    r"\b(bracelet|pendant|necklace|ring|engraved|jewelry|jewellery|gift|earbud(?:s)?|headphones?|buds|wireless|"
    r"portfolio|trading|invest(?:ing|or|ments)?|lump sum|long[- ]term|broker|market)\b"
)
BRAND_PLACED = (
    r"\b((?:got|gave|bought|ordered|wear(?:ing)?|using|collecting)\s+(?:\w+\s+){0,10}?(?:from|on|with)\s+[a-z][a-z0-9-]{3,}|"
    r"(?:bracelet|pendant|necklace|app|platform)\s+(?:from|on)\s+[a-z][a-z0-9-]{3,})\b"
)
REVIEW_FRAME = r"\b(review|reviewed|pros?\b|cons?\b|specs?|unboxing|verdict|compared\s+to|versus|\bvs\.?\b|affiliate|sponsored)\b"
PLACEMENT = r"\b(?:from|on|with|via|using|through|bought\s+(?:at|from)|ordered\s+(?:from|on))\s+"
ACQUISITION = r"\b(?:got|gave|bought|ordered|wear(?:ing)?|using|tried|collecting)\b"
VENUE = r"\b(portfolio|app|platform|broker|trading|account|lump\s+sum)\b"
VENUE_LOOSE = r"portfol|invest|lump\s*sum|\band\s+[a-z]{3,}\b"

# Query intent, tried in this order.
HIGH_STAKES = (
    r"\b(symptom(?:s)?|diagnos(?:e|is|ed)|treat(?:ment|ments|ing)?|cure(?:s|d)?|medication(?:s)?|prescription|dose|dosage|side[\s-]?effect|"
    r"cancer|diabetes|depression|anxiety|chronic|disease|illness|supplement(?:s)?|vaccine|pregnancy|pregnant|overdose|is it safe to|should i take|"
    r"doctor|physician|clinic|lawsuit|attorney|legal advice|will this get me fired|invest(?:ing|ment)? advice|retirement account|tax evasion)\b"
)
NAVIGATIONAL = r"\b(official (?:site|website|page)|homepage|home page|log[\s-]?in|sign[\s-]?in|customer portal|(?:company|brand) website|site:\S+)\b|https?://\S+"
HOSTNAME = r"^(?:https?://)?(?:www\.)?[\w-]+\.(?:com|org|net|io|gov|edu)(?:/\S*)?$"
BEST_HOW_TO = r"\bbest (?:way|ways|method|methods|practice|practices|time|times)\b"
COMMERCIAL = (
    r"\b(best|top\s*\d+|recommend(?:ed|ation)?|buy|purchase|order|shopping|shop for|cheap(?:est)?|deal(?:s)?|coupon|discount|pricing|price of|"
    r"worth (?:it|buying)|should i (?:buy|get|switch)|vs\.?|versus|compare|comparison|alternative(?:s)? (?:to|for)|review(?:s)? of|buying guide|"
    r"which .+ (?:should|to) (?:i |we )?(?:buy|get|use)|affiliate|near me|for sale)\b"
)
INFORMATIONAL = (
    r"\b(how (?:do|to|can|does|did)|how['’]s|what (?:is|are|was|were|does|do|did)|what's|whats|why (?:is|are|do|does|did|can|would)|"
    r"when (?:do|does|did|is|are)|where (?:do|does|did|is|are|can)|who (?:is|are|was|were)|explain|define|definition|meaning of|tutorial|"
    r"recipe|cook(?:ing)?|bake(?:ing)?|steps? (?:to|for)|guide to|instructions? (?:for|on)|learn (?:how|about)|difference between|history of|causes? of)\b"
)
HOW_TO = r"\b(how (?:do|to|can)|recipe|cook(?:ing)?|bake(?:ing)?|tutorial|explain)\b"

# Hosts and paths.
SUSPICIOUS_TLD = r"\.(xyz|top|click|loan|work|fit|icu)$"
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "com.br", "co.in", "com.mx",
    "co.nz", "co.za", "com.sg", "com.hk", "co.kr", "com.tw", "com.cn", "com.ar", "co.il",
]
NEWS_HOSTS = [
    "nytimes.com", "theguardian.com", "washingtonpost.com", "wsj.com", "reuters.com", "bbc.com", "bbc.co.uk", "apnews.com", "npr.org",
    "cnn.com", "bloomberg.com", "ft.com", "economist.com", "latimes.com", "usatoday.com", "time.com", "theatlantic.com", "newyorker.com",
    "politico.com", "axios.com", "cbsnews.com", "nbcnews.com", "abcnews.go.com", "pbs.org", "thehill.com", "forbes.com",
    "businessinsider.com", "independent.co.uk", "telegraph.co.uk", "smh.com.au", "aljazeera.com",
]
FORUM_HOST = (
    r"(?i)(?:^|\.)(?:proboards\.com|boardhost\.com|invisionfree\.com|websitetoolbox\.com|freeforums\.net|forumotion\.com|createaforum\.com|"
    r"niceboard\.com|boards\.net|vbulletin\.net|discourse\.group|vanillaforums\.com|discourse\.com|flarum\.cloud|4chan\.org|4channel\.org|"
    r"4cdn\.org|8kun\.top|8ch\.net|lainchan\.org|endchan\.(?:net|org)|smuglo\.li|wikichan\.org)$"
)
THREAD_PATH = (
    r"(?i)/(?:comments?|forums?|threads?|questions?|discussions?|boards?|topics?|chit[_-]?chat|message[-_]?boards?|showthreads?|forumdisplays?)(?:/|$|\?)"
    r"|/(?:viewtopic|viewforum|showthread|forumdisplay|showpost|printthread|newreply|newthread)\.php"
    r"|/t/[a-z0-9-]+/\d+|/d/[a-z0-9-]+/\d+|/question(?:s)?/|/(?:thread|topic|forum|board)-\d+(?:-[a-z0-9_-]+)*(?:\.html?)?(?:/|$|\?)"
    r"|/(?:discussion|topic|forum|thread)/\d+(?:-[a-z0-9_-]+)?(?:/|$|\?)|/index\.php\?/(?:topic|forum|forums|threads?)/"
    r"|/threads/[a-z0-9_-]+\.\d+(?:/|$|\?)|/(?:[a-z0-9]{1,20}/)?res/\d+(?:\.html?)?(?:/|$|\?)|/[a-z0-9]{1,8}/thread/\d+(?:/|$|\?)"
)
FORUM_QUERY = r"(?i)(?:[?&](?:topic|board|thread|tid|fid|threadid|forumid)=\d)|(?:[?&](?:action)=(?:showthread|forumdisplay|viewtopic|viewforum)\b)"
SOCIAL_PATH = r"(?i)/(posts?|pulse|feed|status)(?:/|$)"
PUBLISH_PATH = r"(?i)/p/[a-z0-9]"
VIDEO_HOST = r"(?i)(?:^|\.)(?:youtube\.com|m\.youtube\.com|youtube-nocookie\.com|youtu\.be)$"
VIDEO_PATH = r"(?i)/(?:watch|shorts)(?:/|$)"
REVIEW_PATH = (
    r"(?i)/(?:product-reviews/|products/[^/]+/reviews(?:/|$)|customer[-_]reviews?(?:/|$)|user[-_]reviews?(?:/|$)|app[-_]reviews?(?:/|$)|"
    r"ratings[-_]and[-_]reviews?(?:/|$)|ratings(?:/|$)|complaints?(?:/|$)|reviews?(?:/|$)|profile/[^?\s]+/(?:customer[-_])?reviews?(?:/|$)|review/[a-z0-9_-]+)"
)
PICKS_PATH = r"(?i)/(picks|best-|roundup|guide)/"
PRODUCT_PATH = r"(?i)/(dp/|product/|products/|shop/|buy/|item/)\b"
SPEC_PATH = r"(?i)productsheets|/literature/|_?spec\.pdf\b|spec_sheet|/psref\b"
DIRECTORY_PATH = r"(?i)/(?:directory|directories)(?:/|$)|/[a-z0-9_-]+[_-]forums?(?:/|$)|/best[-_][a-z0-9_-]*forums?(?:/|$)"
BUY_TEXT = r"\b(buy now|add to cart|free trial|subscribe)\b"
AFFILIATE_TEXT = r"\b(affiliate|sponsored|paid partnership)\b"

# What a post that mentions a brand is up to; looked for in lower-case text.
AFFILIATE_PROMOTION = r"\b(affiliate|sponsored|paid\s+partnership|partner\s+link|my\s+link|use\s+(?:my\s+)?code|discount\s+code|promo\s+code|coupon\s+code)\b"
GLOWING = (
    r"\b(highly\s+recommend|must[- ]buy|game[- ]?changer|life[- ]?changing|best\s+purchase|absolutely\s+love|genuinely\s+love|obsessed\s+with|"
    r"switched\s+to|go\s+with|check\s+(?:them|it)\s+out|worth\s+every\s+(?:penny|cent))\b"
)
RIVAL_BASHING = r"\b(instead\s+of|skip\s+\w+|don'?t\s+buy\s+\w+|avoid\s+\w+|better\s+than\s+\w+|unlike\s+\w+|ditch(?:ed)?\s+\w+|switch(?:ed)?\s+(?:from|away\s+from)\s+\w+)\b"
COMPLAINT = (
    r"\b(scam|fraud|ripoff|rip[- ]off|never\s+received|didn'?t\s+arrive|no\s+refund|stolen|chargeback|do\s+not\s+buy|don'?t\s+buy|customer\s+service|"
    r"terrible|horrible|worst\s+(?:company|experience)|complaint|refund\s+denied|still\s+waiting|ghosted\s+me)\b"
)

# Names in title case, and words that make no name.
TITLE_CASE = r"\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){0,2})\b"
INTERROGATIVES = ["what", "which", "who", "whom", "whose", "where", "when", "why", "how"]
DANGLING = ["in", "for", "with", "and", "or", "to"]
NAME_STOPWORDS = [
    "a", "an", "the", "and", "or", "for", "to", "of", "in", "on", "at", "by", "with", "from", "your", "our", "my", "me", "you", "we", "is", "are", "was", "were", "be", "been",
    "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "this", "that", "these", "those", "right", "wrong", "information", "guide", "guides", "review",
    "reviews", "advice", "tips", "options", "picks", "list", "lists", "article", "blog", "post", "page", "home", "official", "top", "updated", "contents", "forum", "forums",
    "community", "discussion", "thread", "threads", "topics", "topic", "directory",
]
WEAK_MARKERS = [
    "topic", "topics", "forum", "forums", "community", "discussion", "thread", "threads", "index", "home", "top", "best", "reviews", "review", "guide", "blog", "news", "search",
    "login", "about", "contact", "help", "faq", "menu", "categories", "category", "tags", "tag", "latest", "popular", "trending", "messages", "posts", "users", "members",
    "headphones", "laptop", "laptops", "earbuds", "software",
]

# Tiers of listed domains, worst first, and the actions that show a fault of the page itself.
TIERS = ["very_high", "high", "medium", "review", "clean"]
HARD_ACTIONS = ["reject", "reject_consensus", "block_factual_use", "block_endorsement"]
SOFT_ACTIONS = ["attribute_only", "require_corroboration", "require_authoritative_corroboration", "mention_only", "downrank", "defer_fetch"]

# What a fetch tells of a wall of bots, a passing fault, or a useless snapshot; looked for in lower-case text.
BLOCKED_STATUS = [401, 403, 406, 429, 503]
USEFUL_WORDS = 30
LINKS_CHECKED = 8
WALL_SNIPPETS = [
    "access denied", "just a moment", "please enable js", "enable javascript", "cf-browser-verification", "checking your browser", "verify you are human", "attention required",
    "errors.edgesuite.net", "request blocked", "bot detection", "please wait for verification", "wait for verification", "help us keep head-fi secure", "real head-fi'er", "real head-fi",
    "went wrong while validating", "challenge scripts from loading", "verifying your connection", "verifying connection",
]
CHALLENGE_SNIPPETS = [
    "just a moment", "cf-mitigated", "challenges.cloudflare.com", "performing security verification", "verify you are human", "checking your browser", "attention required",
    "enable javascript and cookies", "help us keep head-fi secure", "real head-fi'er", "went wrong while validating", "challenge scripts from loading", "verifying your connection", "verifying connection",
]
TRANSIENT_ERRORS = [
    "timed out", "timeout", "connecterror", "connect error", "connection reset", "connection aborted", "temporarily unavailable", "remote protocol error", "server disconnected", "network is unreachable",
]
SNAPSHOT_JUNK = ["please don't scroll past this", "wayback machine is fighting for universal access", "can you chip in?", "this url has been excluded from the wayback machine"]
PAYWALL_SNIPPETS = [
    "subscribe to continue", "subscribe to read", "subscribe to unlock", "become a subscriber", "this article is for subscribers", "subscribers only", "already a subscriber",
    "create a free account to continue", "sign in to continue reading", "to continue reading", "metered paywall",
]
PAYWALL_TOKENS = ["paywall", "subscribe-gate", "subscription-gate", "piano-offer", "tp-modal", "reg-wall", "regwall", "subscriber-only"]

# Parts of a path that name no product.
PATH_SKIP = [
    "", "www", "p", "product", "products", "shop", "store", "buy", "pricing", "categories", "category", "reviews", "review", "best", "picks", "en", "us", "uk", "index", "html", "model",
    "gaming-keyboard", "audio", "headphones", "headband",
]
PATH_DATE = r"^(?:20\d{2}|(?:0?[1-9]|1[0-2])|(?:0?[1-9]|[12]\d|3[01]))$"
LISTICLE_PREFIX = r"^(the\s+)?(best|top|cheap(est)?|budget)\s+"
GENERIC_NAMES = ["the", "a", "an", "and", "for", "our", "your", "best", "top", "new", "www", "home", "official", "store", "shop", "product", "products", "review", "reviews", "guide", "blog"]
PRICE_HINTS = [r"under\s+\$?\s*(\d+)", r"under\s+(\d+)\s*dollars", r"\$(\d+)\s*or\s*less"]
STEM_LEAST = 4

# Markers that tie a page to no brand in particular.
ORG_STOPWORDS = [
    "the", "a", "an", "and", "for", "our", "your", "best", "top", "new", "www", "home", "store", "shop", "product", "products", "review", "reviews", "guide", "blog", "cheap", "budget",
    "laptops", "laptop", "headphones", "vpn", "software", "topic", "topics", "forum", "forums", "community", "discussion", "thread", "threads", "index", "messages", "posts", "members", "users", "directory",
]
GENERIC_MARKERS = [
    r"^the\s+best\s+", r"^best\s+", r"^top\s+", r"^cheap(est)?\s+", r"^budget\s+", r"\bbuying guide\b", r"\bpicks?\b", r"we'?ve tested", r"\bfor\s+20\d{2}\b", r"\breview(ed|s)?\b",
    r"\bcomparison(s)?\b", r"\bvs\.?\b",
]
NEAR_MISS_CHARS = 120

# Rhetoric of page chrome and of structured answers; limits of what structured data may claim.
BEST_PHRASE = r"\bbest\b.{0,40}"
COMPARATIVE_HIT = r"\b(?:best|#\s*1|ranked|leading|outperforms?|superior|experts?)\b"
RANKED = r"\b(?:#\s*1|ranked)\b"
STACKED_AUTHORITY = r"\b(?:according to experts?|industry[\s-]?leading|top[\s-]?rated|must[\s-]?have|highly recommended)\b"
HOW_TO_TYPES = ["HowTo", "HowToStep", "HowToDirection", "HowToTip"]
ENTITY_TYPES = ["Organization", "Person", "Corporation", "LocalBusiness", "Brand"]
STRONG_PROFILES = ["wikipedia.org", "linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "github.com", "crunchbase.com"]
WEAK_PROFILES = ["bit.ly", "tinyurl", "linktr.ee", "bio.link", "carrd.co", "about.me", "profile.", "profiles."]
PAYMENT_WORDS = ["missinglicensekey", "license key", "checkout", "stripe", "0x", "ethereum", "api key", "paywall"]
