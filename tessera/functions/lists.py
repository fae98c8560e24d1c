"""Word lists and patterns that results depend on."""

# fixed values: words that are no key terms
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare to of in for on with at by from as into"
    " through during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own"
    " same so than too very just and but if or because until while this that these those i me my myself we our ours you your yours he him his she her hers it its they them"
).split()

# fixed values: words that are no signals
SIGNAL_STOP_WORDS = "a an the of in is at for to and or".split()

# fixed values: personal data, in the order in which it is replaced
PII = (
    ("SSN-REDACTED", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("SSN-REDACTED", r"\b\d{9}\b"),
    ("PHONE-REDACTED", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMAIL-REDACTED", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("DOB-REDACTED", r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b"),
    ("DOB-REDACTED", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    ("CC-REDACTED", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ROUTING-REDACTED", r"\b\d{9}\b(?=.{0,20}routing)"),
)

# fixed values: signs of a question that takes a larger model
COMPLEX_SIGNALS = (
    "compare", "analyze", "explain why", "summarize", "what are the implications", "compliance", "gap", "recommend", "strategy", "year over year",
    "trend", "across all", "versus", "pros and cons", "risk assessment",
)

# fixed values: a comparison is asked for
COMPARISON = r"(?i)(?:compar|versus|\bvs\b|difference between)"

# fixed values: labels of intents and the patterns that show them, in order
INTENTS = {
    "active_policy": r"(?i)(?:current|active|bound|in[- ]?force)\b.*?(?:polic|coverage|limit|deductible|premium)",
    "policy_detail": r"(?i)(?:policy)\s+(?:limit|deductible|premium|number|period|effective)",
    "quote": r"(?i)\b(?:quote[ds]?|proposal[s]?|proposed)\b",
    "bind": r"(?i)\b(?:bind|binder|bound|binding)\b",
    "submission": r"(?i)\b(?:submit|submission|application)\b",
    "renewal": r"(?i)\b(?:renewal|renew)\b",
    "endorsement": r"(?i)\b(?:endorsement|rider|amendment)\b",
    "certificate": r"(?i)\b(?:certificate|cert|coi)\b",
    "loss_run": r"(?i)(?:loss\s+run|claims\s+history)",
    "dec_page": r"(?i)(?:declaration|dec\s+page)",
    "earthquake": r"(?i)\b(?:earthquake|quake|seismic)\b",
    "property": r"(?i)\b(?:property|building|structure)\b",
    "gl": r"(?i)(?:general\s+liab|(?<!\w)gl(?!\w)|commercial\s+general)",
    "workers_comp": r"(?i)(?:workers?\s+comp|(?<!\w)wc(?!\w))",
    "do": r"(?i)(?:d\s*&\s*o|directors\s+and\s+officers)",
    "crime": r"(?i)(?:crime|fidelity|employee\s+dishonesty)",
    "epli": r"(?i)(?:epli|employment\s+practices)",
    "umbrella": r"(?i)\b(?:umbrella|excess)\b",
}

# fixed values: (any of these in a question, in lower case; what it is also searched with)
EXPANSIONS = (
    (("customer", "client"), "customer company revenue sales account"),
    (("top", "best", "biggest", "largest", "highest"), "highest revenue largest sales top ranking"),
    (("employee", "staff", "who works", "team"), "employee directory staff name department role"),
    (("budget", "financial", "cost", "expense", "revenue"), "budget expense revenue financial quarterly annual"),
    (("vendor", "supplier"), "vendor supplier company contact procurement"),
    (("inventory", "stock", "product", "sku"), "inventory product SKU quantity stock warehouse"),
    (("policy", "procedure"), "policy procedure guideline rule compliance"),
    (("table", "data", "spreadsheet", "report"), "table data row column statistics report"),
)
