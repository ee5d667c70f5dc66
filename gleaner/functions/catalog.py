"""Fixed values of the extraction rules: synonyms, value shapes, structured-data
paths, word lists and limits.  They decide results, so they are kept together."""

# --- fixed values -----------------------------------------------------------

#: Kinds in the order in which inference tries them, with their synonyms.
SYNONYMS = {
    "Name": ["name", "full name", "fullname", "specialist", "doctor", "dr", "consultant", "practitioner", "provider", "person", "clinician", "surgeon", "therapist"],
    "Location": ["location", "address", "based in", "city", "town", "postcode", "zip", "region"],
    "Currency": ["fee", "fees", "price", "pricing", "cost", "consultation fee", "treatment cost", "charge", "amount"],
    "Email": ["email", "e-mail", "mail"],
    "Phone": ["phone", "telephone", "tel", "mobile", "contact number", "call"],
    "Url": ["website", "url", "link", "profile", "site", "web"],
    "Rating": ["rating", "score", "stars", "review score"],
    "Number": ["reviews", "review count", "count", "number of", "endorsements", "years", "experience", "years experience", "years of experience", "years' experience"],
    "Biography": ["bio", "biography", "about", "about me", "about us", "overview", "summary", "profile description", "introduction", "personal statement"],
}

#: Value shapes per kind, tried in order; Java regular expressions.  ``(?U)``
#: makes digit, word and space classes cover all of Unicode.
PATTERNS = {
    "Currency": [r"(?iU)(?:from\s+)?[£$€]\s?\d[\d,]*(?:\.\d{1,2})?", r"(?iU)\b\d[\d,]*(?:\.\d{1,2})?\s?(?:GBP|USD|EUR)\b"],
    "Email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "Phone": [r"(?U)(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,5}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"],
    "Url": [r"(?iU)https?://[^\s\"'<>]+"],
    "Rating": [r"(?U)\b([0-4](\.\d{1,2})?|5(\.0{1,2})?)\s*/\s*5\b", r"(?iU)\b([0-4](\.\d{1,2})?|5(\.0{1,2})?)\s*(?:stars?|★)\b"],
    "Number": [r"(?iU)\b\d+\+?\s*years?\b"],
    "Location": [r"(?iU)\d+(?:\.\d+)?\s*miles?\s*\|\s*(.+?[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2})", r"(?U)([A-Za-z0-9][^|\n]{4,80}?[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2})"],
}
LABEL_LINE = r"^([A-Za-z][A-Za-z \-]{1,40}?)\s*[:\-]\s*(.+)$"
INITIALS = r"^[A-Z]{1,4}$"
NAME_PREFIX = r"^([A-Z][a-zA-Z'.-]*(?:\s+[A-Z][a-zA-Z'.-]*){1,3})(?=\s|$|[—–\-:,])"
TITLE_RUN = r"(?:[A-Z][a-zA-Z'-]*\s+){1,4}[A-Z][a-zA-Z'-]*"
POSTCODE_END = r"(?i)[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}$"
COOKIE_HEADING = r"(?i)^(this (site|website)|we)\s+use[sd]?\s+cookies"
PAGINATION_TEXT = r"(?i)^(next|prev(ious)?|first|last|»|«|›|‹|>>|<<|\d+)$"
NEXT_TEXT = r"(?i)(next( page)?|»|›|>>|older)$"
QUOTED_PHONE = r'"(\(?\+\d{1,3}\)?[\d\s\-]{6,14}\d)"'
BARE_NUMBER = r"(?U)^[\d,.\s]+$"

#: JSON-LD property paths per kind, lower-cased, in order.
PATHS = {
    "Name": ["name", "legalname", "author.name"],
    "Location": ["address.addresslocality", "address.streetaddress", "address", "areaserved", "location.name"],
    "Currency": ["offers.price", "offers.pricespecification.price", "pricerange", "price"],
    "Email": ["email"],
    "Phone": ["telephone", "phone"],
    "Url": ["url", "sameas"],
    "Rating": ["aggregaterating.ratingvalue", "ratingvalue"],
    "Biography": ["description"],
}
#: Paths of fields that name a role, by field name.
ROLE_PATHS = {
    "role": ["jobtitle", "medicalspecialty.name", "occupation.name", "specialty.name"],
    "job title": ["jobtitle", "medicalspecialty.name", "occupation.name"],
    "jobtitle": ["jobtitle", "medicalspecialty.name", "occupation.name"],
    "title": ["jobtitle", "medicalspecialty.name"],
    "position": ["jobtitle", "occupation.name"],
    "specialty": ["medicalspecialty.name", "occupation.name"],
    "speciality": ["medicalspecialty.name", "occupation.name"],
    "specialization": ["medicalspecialty.name"],
    "profession": ["jobtitle", "occupation.name"],
    "designation": ["jobtitle"],
    "occupation": ["occupation.name", "jobtitle"],
}
STATE_KEYS = {"Email": ["email", "emails"], "Phone": ["phone", "phones", "telephone", "tel"]}
ADDRESS_PARTS = ["streetaddress", "addresslocality", "addressregion", "postalcode"]
NON_CONTENT_TYPES = ["BreadcrumbList", "WebSite", "SiteNavigationElement", "SearchAction", "WebPage", "CollectionPage", "SearchResultsPage"]
FACILITY_TYPES = ["MedicalClinic", "MedicalOrganization", "LocalBusiness", "Hospital", "Clinic", "MedicalBusiness"]

GENERIC_HEADINGS = [
    "about", "overview", "gallery", "testimonials", "contact", "clinics", "credentials", "reviews", "treatments", "professional statement", "frequently asked questions",
    "faq", "faqs", "qualifications", "experience", "specialties", "specialisms", "insurance", "fees", "location", "locations", "map", "biography", "bio",
    "professional experience", "subspecialties", "professional memberships", "education", "positions in organisations", "positions in organizations", "prizes and awards", "languages spoken",
]
COOKIE_CATEGORIES = [
    "necessary cookies", "strictly necessary cookies", "essential cookies", "analytics", "analytics cookies", "performance cookies", "functional cookies", "marketing cookies",
    "targeting cookies", "advertising cookies", "preference cookies", "social media cookies", "optional cookies", "cookie preferences", "manage cookies", "manage cookie preferences", "your privacy choices",
]
HONORIFICS = ["mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame"]
LOCATION_NOISE = ["review", "booking", "years of experience", "/5", "/ 5", "rating"]
CLINIC_MARKERS = ["practice name", "clinic name"]
CHALLENGE_MARKERS = ["just a moment", "verify you are human", "cf-challenge", "captcha", "access denied", "attention required", "checking your browser"]
CONTACT_UNAVAILABLE = "not possible to contact or book an appointment"
HEADINGS = ["h1", "h2", "h3", "h4"]
IGNORED_TAGS = ["script", "style", "head", "meta", "link", "noscript", "svg", "path", "br", "hr"]
HIDDEN_PARENTS = ["script", "style", "noscript", "template"]
PARAGRAPH_TAGS = ["p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6"]
CONTACT_KINDS = ["Phone", "Location", "Email"]

STRATEGIES = ["Selector", "StructuredData", "NextData", "SemanticHtml", "Pattern", "Ai"]
HIGH, MEDIUM = 80, 50
MAX_BODY = 10 * 1024 * 1024
MAX_RECORDS, MAX_FIELDS, MAX_PAGES, MAX_PROFILES, MAX_JOB_PAGES = 1000, 50, 100, 1000, 500
MAX_PREVIEWS, MAX_MATCHES = 5, 500
MIN_SIBLINGS, MAX_GROUP, SAMPLE, MAX_PARENTS = 3, 300, 5, 20_000
#: Address blocks that must not be fetched from (this network, private, loopback, link-local, site-local, unique local).
RESERVED_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "::/128", "::1/128", "fe80::/10", "fec0::/10", "fc00::/7"]
COOLDOWN_S, MAX_COOLDOWNS, POLITE_MS = 8, 3, 200
NO_MATCH, NO_RECORDS = "The record selector did not match any elements.", "No records were found."
MAX_REDIRECTS, MAX_URL, MAX_DELAY_S = 5, 2048, 300
