"""Word lists, lookup tables, patterns and limits.

Everything here is a constant that results depend on.  Where the order of a list decides a result
(first match wins, ties go to the earlier entry) the list is in that order.  Dictionaries that are
too large for source code (first names, words that are not names, industry-code prefixes) are
DataFrame parameters of the functions that need them.
"""

# --- web ------------------------------------------------------------------- fixed values
BLOCKED_HOSTS = [
    "facebook.com", "linkedin.com", "twitter.com", "x.com", "instagram.com", "youtube.com",
    "wikipedia.org", "companieshouse.gov.uk", "beta.companieshouse.gov.uk", "opencorporates.com",
    "bloomberg.com", "crunchbase.com",
]
LEGAL_WORDS_IN_URLS = r"\b(plc|ltd|limited|inc|corp|corporation|llc|llp|gmbh|sa|ag)\b"
LEGAL_WORDS_IN_KEYS = r"\b(ltd|limited|inc|plc|llc|corp|co|the)\b"
LEGAL_WORDS_IN_SLUGS = r"\b(ltd|limited|inc|corp|llc|plc)\b"
LEGAL_WORDS_IN_TITLES = (
    r"(?i)\s*(ltd|limited|llc|inc|plc|corp|corporation|co\.|& co|company|group|holdings|services"
    r"|solutions)\.?\s*"
)
NAME_ENDINGS = ["LTD", "LIMITED", "PLC", "LLC", "INC", r"\(UK\)"]
CONTACT_LINK = r"(?i)(contact|kontakt|get in touch|support)"
HTML_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
]
PROFILE_PATTERNS = [
    ("twitter", r"(?i)https?://(?:www\.)?(?:twitter\.com|x\.com)/[a-zA-Z0-9_]{1,15}/?"),
    ("facebook", r"(?i)https?://(?:www\.)?facebook\.com/[a-zA-Z0-9._\-]+/?"),
    ("instagram", r"(?i)https?://(?:www\.)?instagram\.com/[a-zA-Z0-9._]+/?"),
    ("youtube", r"(?i)https?://(?:www\.)?youtube\.com/(?:channel|c|user|@)/[a-zA-Z0-9_\-]+/?"),
]
SKIP_PROFILES = [
    "twitter.com/home", "twitter.com/login", "twitter.com/search", "twitter.com/explore",
    "twitter.com/i/", "twitter.com/intent", "twitter.com/share",
    "facebook.com/login", "facebook.com/sharer", "facebook.com/share",
    "facebook.com/pages", "facebook.com/help", "facebook.com/privacy",
    "instagram.com/explore", "instagram.com/accounts", "instagram.com/p/",
    "youtube.com/watch", "youtube.com/results", "youtube.com/feed",
]

# --- phones ---------------------------------------------------------------- fixed values
US_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
UK_PHONES = [
    r"(?:\+44|0044|0)[\s.-]?(?:\d[\s.-]?){9,10}",
    r"\d{5}\s?\d{6}",
    r"\d{4}\s?\d{3}\s?\d{4}",
    r"\d{3}\s?\d{4}\s?\d{4}",
]
UK_PHONES_NEAR_NAME = [
    r"(?:\+44|0044|0)[\s.-]?\d{2,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}",
    r"\d{5}\s?\d{6}",
    r"\d{4}\s?\d{3}\s?\d{4}",
]
UK_PHONE_PLACES = ["england", "scotland", "wales", "united kingdom", "uk", "gb"]
PLACEHOLDER_NUMBERS = ["1234567890", "0987654321", "1111111111", "0000000000"]

# --- places ---------------------------------------------------------------- fixed values
UK_COUNTRIES = ["United Kingdom", "England", "Scotland", "Wales", "Northern Ireland"]
UK_SYNONYMS = ["uk", "gb", "united kingdom"]
HOME_NATIONS = ["England", "Wales", "Scotland", "Northern Ireland"]
US_ADDRESS = (
    r"\d+\s+[A-Z][a-zA-Z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way"
    r"|Court|Ct|Place|Pl)[,\s]+[A-Z][a-zA-Z\s]+,\s+[A-Z]{2}\s+\d{5}"
)
UK_POSTCODE = r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}"
UK_POSTCODE_LOOSE = r"(?i)[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}"
UK_ADDRESS_LINE = r"(?i)[\d\w\s,]+[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}"

# --- e-mail ---------------------------------------------------------------- fixed values
EMAIL_SYNTAX = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_IN_TEXT = r"[a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\.[a-zA-Z0-9._-]+"
EMAIL_ON_SITE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MAILTO_LINK = r"(?is)<a\s[^>]*href=[\"']mailto:([^\"'?>\s]+)[^>]*>(.*?)</a>"
MAILTO = r"(?i)mailto:[^\"'>\s]+"
FULL_NAME_PAIR = r"\b([A-Z][a-z]+)\s+([A-Z][a-z]+)\b"
GENERATED_SYNTAX = r"^[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]{2,}$"
DISPOSABLE_DOMAINS = [
    "tempmail.com", "throwaway.email", "guerrillamail.com", "mailinator.com", "temp-mail.org",
    "10minutemail.com", "fakeinbox.com", "trashmail.com", "yopmail.com", "sharklasers.com",
    "dispostable.com", "maildrop.cc", "getnada.com", "tempr.email", "tempail.com", "mohmal.com",
]
CONSUMER_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com",
    "protonmail.com", "zoho.com",
]
GENERIC_MAILBOXES = [
    "info", "contact", "hello", "hi", "enquiries", "enquiry", "admin", "sales", "support", "help",
    "office", "reception", "mail", "email", "customercare", "customerservice", "customer",
    "service", "services", "bookings", "booking", "reservations", "orders", "order", "accounts",
    "billing", "invoices", "payments", "hr", "jobs", "careers", "recruitment", "marketing",
    "press", "media", "pr", "news", "team", "general", "main", "feedback", "complaints",
    "webmaster", "postmaster", "noreply", "no-reply", "donotreply", "auto", "automated", "system",
    "notify", "notifications", "subscribe", "unsubscribe", "newsletter", "updates", "alerts",
]
ROLE_MAILBOXES = [
    "info", "contact", "hello", "enquiries", "admin", "sales", "support", "help", "office",
    "reception", "mail", "customer", "service", "bookings", "orders", "accounts", "hr", "jobs",
    "careers", "marketing", "press", "team", "general", "feedback", "noreply", "newsletter",
]
SITE_ROLE_MAILBOXES = [
    "info", "contact", "hello", "enquiries", "admin", "sales", "support", "help", "office",
    "reception", "mail", "customer", "service", "bookings", "orders", "accounts", "hr", "jobs",
    "careers", "marketing", "press", "team", "general", "feedback", "noreply", "newsletter",
    "billing", "enquiry", "webmaster", "postmaster", "abuse",
]
SITE_GENERIC = (
    r"(?i)^(info|contact|hello|support|sales|admin|noreply|no-reply|enquiries|enquiry|mail|office)"
    r"[@+_.-]"
)
PREFERRED_GENERIC = ["hello@", "info@", "contact@"]
EMAIL_PATTERNS = [
    "{first}.{last}", "{first}{last}", "{f}{last}", "{first}", "{first}_{last}", "{last}.{first}",
    "{f}.{last}", "{first}{l}", "{f}{l}", "{last}", "{last}{first}", "{last}{f}", "{first}-{last}",
    "{f}_{last}", "{first}.{l}",
]
FAKE_EMAIL_PARTS = [
    "test@", "fake@", "sample@", "example@", "demo@", "noreply@", "no-reply@", "donotreply@",
    "admin@test", "user@test", "@test.com", "@example.com", "@mailinator", "@tempmail",
    "@guerrilla", "@throwam",
]
GIBBERISH = r"^[^aeiouAEIOU]{6,}$|(.)\1{4,}|^[a-z]{1,2}\d{3,}|^\d+$"

# --- people and titles ----------------------------------------------------- fixed values
NAME_PAIR = r"\b([A-Z][a-z]{1,15})\s+([A-Z][a-z]{1,20})\b"
NAME_DASH_TITLE = (
    r"([A-Z][a-z]{2,15}(?:\s+[A-Z][a-z]{0,15})*)\s*[-–—|]\s*([A-Za-z\s&,./]+?)(?:\s+at\s+|\s+@\s+|\s*\||\s*LinkedIn)"
)
NAME_COMMA_TITLE = r"([A-Z][a-z]{1,15}\s+[A-Z][a-z]{1,20})\s*,\s+([A-Za-z\s]+)"
WORD_ENDINGS_STRICT = (
    r"(tion|ment|ness|ship|hood|ity|ism|ous|ful|less|able|ible|ward|wise|like|free|ing|ence|ance"
    r"|ery|ory|ure|ive|ical|ular|dom)$"
)
WORD_ENDINGS_LENIENT = (
    r"(tion|ment|ness|ship|hood|ity|ism|ous|ful|less|able|ible|ward|wise|like|free|ing|ence|ance"
    r"|ery|ory|ure|ive|ical|ular|ster|dom)$"
)
WORD_ENDINGS_CLEANUP = r"(tion|ment|ness|ship|hood|ity|ism|ist|ive|ous|ful|less|able|ible|ward|wise|like|free)$"
NOT_A_SURNAME = [
    "all", "buy", "day", "tag", "type", "way", "run", "set", "put", "get", "let", "say", "use",
    "try", "ask", "add", "end", "own", "big", "old", "new", "few", "top", "off", "hot", "low",
    "due", "key", "act", "age", "air", "arm", "art", "bad", "bag", "bed", "bit", "box", "bus",
    "car", "cup", "cut", "dog", "ear", "egg", "eye", "fan", "fit", "fly", "fun", "gap", "gas",
    "god", "gun", "hat", "hit", "ice", "job", "joy", "kid", "lab", "law", "leg", "lip", "log",
    "lot", "map", "mix", "net", "nor", "oil", "pan", "pay", "pet", "pie", "pin", "pot", "raw",
    "row", "sea", "sir", "sit", "six", "sky", "son", "sum", "sun", "tax", "tea", "ten", "tie",
    "tip", "toe", "too", "top", "toy", "van", "war", "web", "win", "won", "yes", "yet", "zip",
    "the", "and", "but", "not", "you", "his", "her", "she", "him", "who", "its", "how", "may",
    "did", "got", "has", "any", "per", "via", "our", "two", "way",
]
COMMON_LEADING_WORDS = (
    r"^(the|and|for|with|our|all|new|old|big|top|best|first|last|next|only|real|true|full|high|low"
    r"|open|free|easy|fast|hard|soft|long|short|wide|deep|dark|light|good|bad|hot|cold|dry|wet|raw"
    r"|current|safe|bank|quantity|special|comprehensive|general|total|main|major|minor|super|extra"
    r"|ultra|mega|mini|micro|macro|multi|mono|semi|anti|pre|post|pro|non|sub|co|re|un|in|out|up"
    r"|down|over|under|inter|trans|cross|self|auto|tele|cyber|bio|eco|geo|techno|electro|hydro"
    r"|photo|thermo|aero|astro|cosmo|any|some|every|no|each|few|many|much|more|most|less|least"
    r"|such|what|which|who|whom|whose|how|why|when|where|there|here|this|that|these|those)$"
)
TITLE_GARBAGE = r"(?i)cookie|consent|subscribe|login|checkout|click|download|accept all|manage|privacy|terms"
ROLE_WORDS = [
    "director", "ceo", "cto", "cfo", "coo", "cmo", "cio", "chief", "president", "vice president",
    "owner", "founder", "partner", "principal", "head of", "general manager", "manager",
    "supervisor", "lead", "secretary", "treasurer", "chair", "accountant", "solicitor",
    "barrister", "lawyer", "counsel", "engineer", "architect", "consultant", "analyst", "advisor",
    "officer", "specialist", "coordinator", "vp ", " vp",
]
SENIORITY = [
    ("C-Suite", r"\b(ceo|cto|cfo|cmo|coo|chief|founder|owner|president|partner|managing director|md)\b"),
    ("Director", r"\b(vp|vice president|director|head of|principal)\b"),
    ("Senior", r"\b(senior|sr\.?|lead|staff)\b"),
    ("Manager", r"\b(manager|supervisor|team lead)\b"),
    ("Junior", r"\b(junior|jr\.?|associate|graduate|intern|trainee|entry)\b"),
    ("Mid", r"\b(consultant|specialist|analyst|engineer|developer|designer|executive|coordinator)\b"),
]
MANAGEMENT_TITLES = [
    (r"\bchief executive officer\b|\bceo\b", "CEO", 1),
    (r"\bchief financial officer\b|\bcfo\b", "CFO", 1),
    (r"\bchief technology officer\b|\bcto\b", "CTO", 1),
    (r"\bchief operating officer\b|\bcoo\b", "COO", 1),
    (r"\bchief marketing officer\b|\bcmo\b", "CMO", 1),
    (r"\bchief information officer\b|\bcio\b", "CIO", 1),
    (r"\bchief people officer\b|\bcpo\b", "CPO", 1),
    (r"\bco-?founder\b", "Co-Founder", 1),
    (r"\bfounder\b", "Founder", 1),
    (r"\bco-?owner\b", "Co-Owner", 1),
    (r"\bowner\b", "Owner", 1),
    (r"\bpresident\b", "President", 1),
    (r"\bmanaging director\b", "Managing Director", 2),
    (r"\bexecutive director\b", "Executive Director", 2),
    (r"\bnon-?executive director\b|\bned\b", "Non-Executive Director", 2),
    (r"\bsales director\b", "Sales Director", 2),
    (r"\boperations director\b", "Operations Director", 2),
    (r"\bcommercial director\b", "Commercial Director", 2),
    (r"\bfinance director\b", "Finance Director", 2),
    (r"\bmarketing director\b", "Marketing Director", 2),
    (r"\btechnical director\b", "Technical Director", 2),
    (r"\bit director\b", "IT Director", 2),
    (r"\blogistics director\b", "Logistics Director", 2),
    (r"\bsupply chain director\b", "Supply Chain Director", 2),
    (r"\bhr director\b|\bhuman resources director\b", "HR Director", 2),
    (r"\bbusiness development director\b", "Business Development Director", 2),
    (r"\bdirector\b", "Director", 2),
    (r"\bsenior vice president\b|\bsvp\b", "Senior Vice President", 2),
    (r"\bexecutive vice president\b|\bevp\b", "Executive Vice President", 2),
    (r"\bvice president\b|\bvp of\b", "Vice President", 2),
    (r"\bmanaging partner\b", "Managing Partner", 2),
    (r"\bsenior partner\b", "Senior Partner", 2),
    (r"\bpartner\b", "Partner", 2),
    (r"\bgeneral manager\b", "General Manager", 3),
    (r"\bregional manager\b", "Regional Manager", 3),
    (r"\bsales manager\b", "Sales Manager", 3),
    (r"\boperations manager\b", "Operations Manager", 3),
    (r"\blogistics manager\b", "Logistics Manager", 3),
    (r"\bsupply chain manager\b", "Supply Chain Manager", 3),
    (r"\bfinance manager\b|\bfinancial controller\b", "Finance Manager", 3),
    (r"\bmarketing manager\b", "Marketing Manager", 3),
    (r"\bbusiness development manager\b", "Business Development Manager", 3),
    (r"\bhr manager\b|\bhuman resources manager\b", "HR Manager", 3),
    (r"\bit manager\b", "IT Manager", 3),
    (r"\bproject manager\b", "Project Manager", 3),
    (r"\baccount manager\b", "Account Manager", 3),
    (r"\bcommercial manager\b", "Commercial Manager", 3),
    (r"\bwarehouse manager\b", "Warehouse Manager", 3),
    (r"\bhead of sales\b", "Head of Sales", 3),
    (r"\bhead of operations\b", "Head of Operations", 3),
    (r"\bhead of finance\b", "Head of Finance", 3),
    (r"\bhead of marketing\b", "Head of Marketing", 3),
    (r"\bhead of logistics\b", "Head of Logistics", 3),
    (r"\bhead of supply chain\b", "Head of Supply Chain", 3),
    (r"\bhead of it\b|\bhead of technology\b", "Head of IT", 3),
    (r"\bhead of hr\b|\bhead of human resources\b", "Head of HR", 3),
    (r"\bhead of business development\b", "Head of Business Development", 3),
    (r"\bhead of\b", "Head of Department", 3),
]
PAGE_TITLES = [
    "director", "managing director", "executive director", "ceo", "cto", "cfo", "coo", "cmo",
    "cio", "chief executive", "chief technology", "chief financial", "chief operating",
    "chief marketing", "president", "vice president", "vp", "svp", "owner", "co-owner", "founder",
    "co-founder", "partner", "managing partner", "senior partner", "principal", "head of",
    "general manager",
]
OFFICER_TITLES = {"director": "Director", "llp-member": "Partner", "cic-manager": "Manager"}

# --- company names --------------------------------------------------------- fixed values
SPAM_PHRASES = [
    "how to", "what is", "why does", "where to", "free download", "click here", "buy now",
    "top 10", "top 5", " review", "reviews", "near me", "wikipedia", "facebook", "twitter",
    "instagram", "youtube", "linkedin.com", "google.com", ".pdf", ".doc",
]
URL_PARTS = ["http", "www.", ".com", ".co.uk", ".org", ".net"]
DISCOVERY_SPAM = (
    r"(?i)how to|what is|best \d|top \d|reviews?|near me|cheap|discount|\.com|\.co\.uk|http|www\."
    r"|wikipedia|facebook|twitter"
)
HEADLINE_PHRASES = [
    "openings in your area", "urgent openings", "california companies (top", "top 10k",
    "governing ai", "for nearly half", "startups in ...", "apply now", "click here", "read more",
    "learn more", "find out", "subscribe", "visit our", "call us", "contact us",
]
FAKE_SOURCES = ["OpenAI", "Fallback", "Generated", "Test"]
PROTECTED_SOURCES = ["Companies House", "OpenStreetMap"]
SYNTHETIC_NAME = (
    r"^(Central|Downtown|Uptown|Midtown|Urban|Metro|Summit|Elite|Premier|Golden|Apex|Prime) .*"
    r"(Bistro|Shop|Store|Services|Solutions|Partners|Group|Associates|Pros)$"
)
FAKE_NAMES = [
    "Katz's Delicatessen", "Katz''s Delicatessen", "Strand Bookstore", "Test Company Ltd",
    "Ess-a-Bagel", "Levain Bakery", "Russ & Daughters", "Russ and Daughters", "Sample Company",
    "Demo Company", "Test Business",
]

# --- industries ------------------------------------------------------------ fixed values
STANDARD_INDUSTRIES = [
    "Technology", "Healthcare", "Financial Services", "Manufacturing", "Retail & Shopping",
    "Restaurants & Food", "Professional Services", "Construction", "Real Estate",
    "Legal Services", "Education", "Marketing & Advertising", "Automotive", "Hotels & Lodging",
    "Transportation", "Energy", "Telecommunications", "Media & Publishing", "Entertainment",
    "Fitness & Sports", "Non-Profit", "Government", "Agriculture", "Mining", "Travel & Tourism",
    "Food & Beverage",
]
UNCLASSIFIED = ["", "Unknown", "Other", "Professional Services"]
SIC_TEXT = [
    ("software", "Technology"), ("computer", "Technology"),
    ("information technology", "Technology"), ("construction", "Construction"),
    ("building", "Construction"), ("retail", "Retail Trade"), ("wholesale", "Wholesale Trade"),
    ("financial", "Financial Services"), ("banking", "Financial Services"),
    ("insurance", "Financial Services"), ("property", "Real Estate"),
    ("real estate", "Real Estate"), ("restaurant", "Food & Beverage"),
    ("food", "Food & Beverage"), ("manufacturing", "Manufacturing"), ("education", "Education"),
    ("health", "Healthcare"), ("medical", "Healthcare"),
    ("consulting", "Professional Services"), ("legal", "Professional Services"),
]
SIC_DIVISIONS = {
    "62": "Technology", "63": "Technology",
    "70": "Professional Services", "71": "Professional Services", "72": "Professional Services",
    "46": "Wholesale Trade", "47": "Retail Trade", "56": "Food & Beverage", "68": "Real Estate",
    "64": "Financial Services", "65": "Financial Services", "66": "Financial Services",
    "41": "Construction", "42": "Construction", "43": "Construction",
}
SIC_DIVISIONS_DETAILED = {
    "01": "Agriculture", "02": "Agriculture", "03": "Agriculture",
    "05": "Mining", "06": "Mining", "07": "Mining", "08": "Mining", "09": "Mining",
    "10": "Food & Beverage", "11": "Food & Beverage", "12": "Food & Beverage",
    "13": "Manufacturing", "14": "Manufacturing", "15": "Manufacturing", "16": "Manufacturing",
    "17": "Manufacturing", "18": "Manufacturing", "19": "Manufacturing", "20": "Manufacturing",
    "21": "Manufacturing", "22": "Manufacturing", "23": "Manufacturing", "24": "Manufacturing",
    "25": "Manufacturing", "26": "Technology", "27": "Manufacturing", "28": "Manufacturing",
    "29": "Automotive", "30": "Manufacturing", "31": "Manufacturing", "32": "Manufacturing",
    "33": "Manufacturing", "35": "Energy", "36": "Energy", "37": "Energy", "38": "Energy",
    "39": "Energy", "41": "Construction", "42": "Construction", "43": "Construction",
    "45": "Automotive", "46": "Retail & Shopping", "47": "Retail & Shopping",
    "49": "Transportation", "50": "Transportation", "51": "Transportation",
    "52": "Transportation", "53": "Transportation", "55": "Hotels & Lodging",
    "56": "Restaurants & Food", "58": "Media & Publishing", "59": "Media & Publishing",
    "60": "Media & Publishing", "61": "Telecommunications", "62": "Technology",
    "63": "Technology", "64": "Financial Services", "65": "Financial Services",
    "66": "Financial Services", "68": "Real Estate", "69": "Legal Services",
    "70": "Professional Services", "71": "Professional Services", "72": "Technology",
    "73": "Marketing & Advertising", "74": "Professional Services",
    "75": "Professional Services", "77": "Professional Services", "78": "Professional Services",
    "79": "Travel & Tourism", "80": "Professional Services", "81": "Professional Services",
    "82": "Professional Services", "84": "Government", "85": "Education", "86": "Healthcare",
    "87": "Healthcare", "88": "Healthcare", "90": "Entertainment", "91": "Entertainment",
    "92": "Entertainment", "93": "Fitness & Sports", "94": "Non-Profit",
    "95": "Professional Services", "96": "Professional Services",
}
INDUSTRY_KEYWORDS = [
    ("Technology", ["software", "tech", "digital", "IT ", "computing", "cyber", "data", "cloud",
                    "app ", "SaaS", "AI ", "machine learning", "blockchain", "web develop",
                    "programmer", "developer"]),
    ("Healthcare", ["medical", "health", "hospital", "clinic", "dental", "dentist", "doctor",
                    "physician", "pharmacy", "pharma", "nursing", "care home", "optician",
                    "therapist", "physiotherapy", "surgery", "veterinary", "vet "]),
    ("Financial Services", ["bank", "finance", "financial", "insurance", "mortgage",
                            "accounting", "accountant", "tax ", "investment", "wealth", "credit",
                            "lending", "fintech", "pension", "fund "]),
    ("Manufacturing", ["manufacturing", "factory", "fabricat", "industrial", "precision",
                       "machining", "production", "assembly", "tooling"]),
    ("Retail & Shopping", ["retail", "shop ", "store", "boutique", "e-commerce", "ecommerce",
                           "wholesale", "supermarket", "market "]),
    ("Restaurants & Food", ["restaurant", "cafe", "catering", "pizza", "burger", "sushi",
                            "bistro", "diner", "takeaway", "bakery", "pub ", "bar ", "grill",
                            "kitchen"]),
    ("Professional Services", ["consulting", "consultancy", "consultant", "advisory",
                               "management", "recruitment", "staffing", "HR ", "human resource",
                               "outsourcing", "training", "coaching"]),
    ("Construction", ["construction", "building", "builder", "plumbing", "plumber",
                      "electrical", "electrician", "roofing", "renovation", "contractor",
                      "joiner", "carpenter", "paving", "demolition", "scaffolding"]),
    ("Real Estate", ["real estate", "property", "estate agent", "letting", "rental", "housing",
                     "land ", "surveyor", "conveyancing"]),
    ("Legal Services", ["law ", "legal", "solicitor", "lawyer", "barrister", "attorney",
                        "notary", "litigation", "paralegal"]),
    ("Education", ["school", "university", "college", "education", "academy", "tutor",
                   "learning", "training centre"]),
    ("Marketing & Advertising", ["marketing", "advertising", "media agency", "PR ",
                                 "public relations", "branding", "creative agency", "SEO",
                                 "social media"]),
    ("Automotive", ["auto ", "car ", "motor", "garage", "vehicle", "tyre", "tire", "MOT ",
                    "bodyshop", "car wash", "driving"]),
    ("Hotels & Lodging", ["hotel", "hostel", "B&B", "bed and breakfast", "motel", "guest house",
                          "inn ", "lodge", "resort"]),
    ("Transportation", ["transport", "logistics", "shipping", "courier", "delivery", "freight",
                        "haulage", "trucking", "moving", "taxi", "cab "]),
    ("Energy", ["energy", "solar", "wind ", "oil ", "gas ", "petroleum", "electric",
                "renewable", "power "]),
    ("Telecommunications", ["telecom", "broadband", "internet provider", "mobile network",
                            "fiber", "fibre"]),
    ("Media & Publishing", ["media", "publishing", "newspaper", "magazine", "broadcast", "radio",
                            "television", "film ", "video production", "print"]),
    ("Entertainment", ["entertainment", "gaming", "cinema", "theatre", "theater", "music",
                       "event", "leisure", "amusement"]),
    ("Fitness & Sports", ["fitness", "gym", "sport", "yoga", "pilates", "swimming",
                          "martial art", "boxing", "personal trainer"]),
    ("Travel & Tourism", ["travel", "tourism", "holiday", "vacation", "tour ", "cruise",
                          "flight", "airline"]),
    ("Agriculture", ["farm", "agriculture", "agricultural", "livestock", "crop", "harvest",
                     "dairy", "organic farm"]),
]
PAGE_TEXT_THRESHOLD = 10
INDUSTRY_SYNONYMS = [
    ("it", "Technology"), ("software", "Technology"), ("saas", "Technology"),
    ("web", "Technology"), ("digital", "Technology"), ("internet", "Technology"),
    ("medical", "Healthcare"), ("health", "Healthcare"), ("dental", "Healthcare"),
    ("banking", "Financial Services"), ("insurance", "Financial Services"),
    ("accounting", "Financial Services"), ("finance", "Financial Services"),
    ("shop", "Retail & Shopping"), ("retail", "Retail & Shopping"),
    ("food", "Restaurants & Food"), ("restaurant", "Restaurants & Food"),
    ("catering", "Restaurants & Food"), ("hospitality", "Hotels & Lodging"),
    ("hotel", "Hotels & Lodging"), ("accommodation", "Hotels & Lodging"),
    ("consulting", "Professional Services"), ("recruitment", "Professional Services"),
    ("building", "Construction"), ("construction", "Construction"),
    ("property", "Real Estate"), ("real estate", "Real Estate"),
    ("law", "Legal Services"), ("legal", "Legal Services"),
    ("school", "Education"), ("education", "Education"),
    ("marketing", "Marketing & Advertising"), ("advertising", "Marketing & Advertising"),
    ("motor", "Automotive"), ("automotive", "Automotive"), ("car", "Automotive"),
    ("transport", "Transportation"), ("logistics", "Transportation"),
    ("energy", "Energy"), ("power", "Energy"), ("oil", "Energy"),
    ("telecom", "Telecommunications"), ("media", "Media & Publishing"),
    ("entertainment", "Entertainment"), ("sport", "Fitness & Sports"),
    ("fitness", "Fitness & Sports"), ("gym", "Fitness & Sports"),
    ("travel", "Travel & Tourism"), ("tourism", "Travel & Tourism"),
    ("farm", "Agriculture"), ("agriculture", "Agriculture"),
    ("charity", "Non-Profit"), ("non-profit", "Non-Profit"), ("nonprofit", "Non-Profit"),
]
DESCRIPTION_HINTS = [
    ("software", "Software"), ("consulting", "Consulting"), ("manufactur", "Manufacturing"),
    ("marketing", "Marketing"), ("finance", "Financial Services"),
    ("financial", "Financial Services"), ("health", "Health"), ("education", "Education"),
]

# --- scores and weights ---------------------------------------------------- fixed values
QUALITY_WEIGHTS = [
    ("company_name", 10), ("website", 15), ("phone_number", 15), ("address", 10),
    ("email_format", 10), ("linkedin_url", 10), ("industry", 5), ("city", 5),
]
PHONE_JOB_WEIGHTS = [("email_format", 4), ("linkedin_url", 3), ("address", 2), ("industry", 1)]
WEBSITE_JOB_WEIGHTS = [
    ("phone_number", 4), ("email_format", 4), ("linkedin_url", 3), ("city", 2), ("industry", 1),
    ("country", 1),
]
CONTACT_JOB_WEIGHTS = [("website", 3), ("email_format", 4), ("linkedin_url", 2), ("phone_number", 1)]
HALF_ENRICHED_WEIGHTS = [
    ("phone_number", 3), ("email_format", 3), ("linkedin_url", 2), ("address", 2), ("industry", 1),
    ("city", 1),
]
EMPTY_WEIGHTS = [("city", 2), ("country", 1)]
MERGE_FIELDS = [
    "website", "email", "phone", "linkedin_url", "address_line_1", "locality", "region",
    "postal_code", "registration_number",
]
TARGETS = {
    "United States": 35000000, "China": 50000000, "India": 30000000, "Brazil": 20000000,
    "United Kingdom": 6000000, "Germany": 3500000, "France": 4000000, "Japan": 4000000,
    "Italy": 5000000, "Mexico": 5000000, "Spain": 3500000, "Canada": 1500000,
    "Australia": 2500000, "South Korea": 3000000, "Indonesia": 5000000, "Turkey": 3000000,
    "Thailand": 3000000, "Netherlands": 2000000, "Poland": 2000000, "Argentina": 2000000,
    "Other": 10000000,
}
TOTAL_TARGET = 200000000
GRID_DEGREES = 0.05

# --- lead blocks ------------------------------------------------------------ fixed values
LEAD_AT = r"(?i)^(.+?)\s+(?:at|@)\s+(.+)$"
LEAD_LINE_AT = r"(?i)^(.{3,60})\s+(?:at|@)\s+(.{2,60})$"
LEAD_WEB_WORDS = r"(?i)connect|follow|message|degree|mutual|view"
LEAD_NAME = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
LEAD_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
LEAD_PHONE = r"[\+]?[\d][\d\s\-(). ]{6,16}[\d]"
LEAD_FILTER_BRACKETS = r'^[\["\]]+|[\["\]]+$'
LEAD_NAME_NOISE = [
    r"^[\s•·\-–—|]+", r"[\s•·\-–—|]+$", r"(?i)\b\d+(st|nd|rd|th)\+?\b", r"<[^>]*>", r"[^a-zA-ZÀ-ÿ\s'.\-]",
]
BULLET_FREE = r"([A-Z][^·•@\n]{3,50}?)\s+(?:at|@)\s+([A-Z][^·•@\n\d]{2,60})"
BULLET_PLACE = r"([A-Z][a-zA-Z ]{2,30}),\s*([A-Z][a-zA-Z ]{2,30})"
BULLET_EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
BULLET_PHONE = r"(?:\+\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)(?:\d{3,4}[\s\-]?\d{3,4})"

#: Weights of the lenient first-name test; not from any source.
FIRST_NAME_SCORES = {"known": 100, "plausible": 60, "ordinary_word": 20, "malformed": 0}
