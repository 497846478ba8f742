"""Term lists that drive every matcher.

A lexicon is a plain mapping ``name -> tuple of terms``. The operators never
hard-code a term: they look the lists up by name, so another domain is another
mapping (or another table, see :func:`from_table`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# ---------------------------------------------------------------------------
# The default domain profile. Order and spelling matter, because
# matched terms are reported in list order and cut to the first few.
# ---------------------------------------------------------------------------

JOB = [
    "full-time", "part-time", "contractor", "product engineer", "software engineer",
    "apply now", "apply for this job", "job description", "equal opportunity employer",
    "salary range", "benefits", "careers", "hiring",
]

PROMOTIONAL = [
    "book a demo", "request a demo", "sign up", "get started", "learn more",
    "our platform", "we help companies", "we empower", "world-class", "best-in-class",
    "all-in-one", "revolutionary", "seamlessly", "unlock", "trusted by", "transform your",
]

DIRECTORY = [
    "company profile", "founded in", "headquartered", "number of employees",
    "pricing, reviews", "reviews and alternatives", "alternatives and competitors",
    "software category", "provider of", "overview of", "directory",
]

CONVERSATIONAL = [
    "i ", "i've", "i'm", "we ", "we've", "my ", "our ", "for us", "for me", "tried",
    "using", "use it", "switched", "compared", "complain", "keep saying", "people say",
    "teams say", "users say",
]

QUALITY = [
    "annoying", "barrier", "bug", "complain", "confusing", "crash", "difficult",
    "doesn't work", "expensive", "frustrating", "hard", "inaccurate", "issue", "missing",
    "need", "pain", "privacy", "problem", "setup", "scattered", "slow", "still need",
    "stuck", "too long", "trust", "workflow", "wrong",
]

REMOTE = ["remote"]
REMOTE_JOB_CONTEXT = ["apply", "hiring", "job", "salary"]
COMPANY_OPENINGS = ["we are ", "we're ", "our mission", "our product", "our app"]
CUSTOMER_VOICE = [" i ", " my ", " for me", " tried", " using"]
OPINION_MARKERS = ["i ", "we ", "my ", "our ", "but", "because", "keep saying", "complain"]
EXPERIENCE_MARKERS = [" i ", " my ", " we ", " our ", "use", "using", "tried"]

BUSINESS_SCOPE = [
    "small business", "one-person", "solo", "solo founder", "lean team", "small team",
    "small company", "owner", "customer", "customers", "admin", "operations", "invoicing",
    "invoice", "crm", "scheduling", "customer records", "follow-up", "bookkeeping",
    "payroll", "sales pipeline", "lead", "leads",
]

WORKFLOW_FRICTION = [
    "workflow", "workflow automation", "manual work", "manual process", "manual cleanup",
    "too many tools", "scattered", "handoff", "follow-up", "repeatable", "repetitive",
    "busywork", "automation", "automate", "operational", "operations",
]

PRACTICAL_TOOL = [
    "zapier", "n8n", "airtable", "hubspot", "salesforce", "quickbooks", "stripe",
    "shopify", "notion", "slack", "google sheets", "crm", "invoicing", "scheduling",
]

AI_OPERATIONAL = ["ai", "llm", "agent", "assistant", "copilot", "ai-enabled"]

TECHNICAL_DETAIL = [
    "api", "apis", "endpoint", "json", "python", "javascript", "typescript", "docker",
    "kubernetes", "database", "sql", "server", "oauth", "token", "stack trace", "library",
    "package", "dependency", "sdk", "webhook", "http", "request", "response", "runtime",
    "deployment", "container", "hosting",
]

# Extra terms of the two joined lists (scope + friction + tools + these).
TECHNICAL_ALLOWANCE_EXTRA = ["integration", "sync"]
CONTEXT_ANCHOR_EXTRA = [
    "business", "client", "clients", "company", "founder", "operator", "accounting",
    "support", "sales", "marketing", "integration", "api", "webhook", "setup",
    "onboarding", "permission", "tool", "tools", "saas",
]

ADOPTION = [
    "setup", "install", "configure", "configuration", "onboarding", "permission",
    "credential", "authentication", "integration", "api", "sync", "migration",
    "switching", "too complex", "hard to use", "learning curve", "workflow",
    "workflow burden", "switching cost",
]

DISSATISFACTION = [
    "frustrating", "too complicated", "complicated", "doesn't work", "not working",
    "fails", "failed", "error", "missing", "manual", "still have to", "wrong",
    "inaccurate", "poor fit", "doesn't fit", "not useful", "slow", "broken", "support",
]

PROMOTION = [
    "show hn", "launch hn", "hi hn", "i'm one of the creators",
    "i am one of the creators", "i'm the founder", "i am the founder", "as the founder",
    "i built", "i made", "i launched", "i just launched", "we just launched",
    "check out", "try my", "my startup", "my product", "my app", "we built",
    "we launched", "we're launching", "we are launching", "our product", "our app",
    "our platform", "product hunt", "sign up", "book a demo", "landing page", "waitlist",
    "request for feedback", "would love feedback", "introducing",
]

GENERIC_ENTERPRISE = ["sharepoint", "enterprise", "corporate", "fortune 500", "large organization"]
GENERIC_SCOPE_ESCAPE = ["small business", "small team", "solo", "workflow", "admin", "crm"]
QUOTE = ["quote", "says:", "said:", "according to"]

CULTURAL_QUOTE = [
    "movie quote", "favorite quote", "film", "scene", "character", "spielberg",
    "timeless quote", "quote comes from", "quote about",
]

UNMET_NEED = [
    "need", "wish", "want", "looking for", "would pay", "if only", "missing",
    "should support", "doesn't support",
]
UNMET_NEED_SETTING = [
    "business", "customer", "client", "integration", "api", "webhook", "setup",
    "onboarding", "permission", "tool", "tools", "saas", "manage",
]

FIRST_PERSON_ACTORS = [" i ", " we ", " my ", " our ", " users ", " customers "]
PAIN_ACTORS = [
    " i ", " we ", " my ", " our ", " user ", " users ", " customer ", " customers ",
    " team ", " business ",
]

TECHNICAL_DIRECT_CONTEXT = ["workflow automation", "crm", "saas", "business tool", "customer", "operational data"]
TECHNICAL_SETUP_CONTEXT = ["webhook", "api", "authentication", "setup", "integration"]

STRONG_ADOPTION = [
    "setup", "onboarding", "integration", "permission", "switching", "migration",
    "workflow burden", "implementation burden",
]
STRONG_DISSATISFACTION = [
    "poor fit", "too complicated", "complexity", "missing", "manual", "frustrating",
    "doesn't fit", "fragmented", "slow",
]

# Signal categories, in extraction order (four problem groups, two barrier groups,
# one differentiation group).
SIGNALS = {
    "recurring_problem_signals": [
        "problem", "pain", "hard", "difficult", "frustrating", "annoying", "manual",
        "waste", "scattered", "slow", "broken", "missing",
    ],
    "unmet_needs": [
        "need", "wish", "want", "looking for", "would pay", "if only", "missing",
        "should support", "doesn't support",
    ],
    "community_traction_clues": [
        "using", "tried", "recommend", "switched", "adopted", "team", "customers",
        "demand", "popular", "save time",
    ],
    "competing_solution_mentions": [
        "notion", "slack", "google", "microsoft", "zoom", "teams", "linear", "jira",
        "asana", "todoist", "obsidian",
    ],
    "adoption_barriers": [
        "setup", "integration", "permission", "privacy", "security", "expensive",
        "price", "cost", "learning curve", "workflow", "trust", "accuracy", "too long",
        "hard to use",
    ],
    "dissatisfaction_current_solutions": [
        "bug", "crash", "slow", "wrong", "inaccurate", "doesn't work", "not useful",
        "still need", "manual cleanup", "missing", "frustrating",
    ],
    "differentiation_opportunities": [
        "better", "easier", "automatic", "export", "search", "workflow", "integrate",
        "integration", "privacy", "accurate", "action items", "decisions", "follow-up",
        "custom", "missing",
    ],
}

# Category titles, in summary order.
CATEGORY_TITLES = {
    "recurring_problem_signals": "Recurring operational pain signals",
    "unmet_needs": "Unmet needs",
    "adoption_barriers": "Adoption barriers",
    "dissatisfaction_current_solutions": "Dissatisfaction with current solutions",
    "differentiation_opportunities": "Differentiation opportunities",
    "community_traction_clues": "Community traction clues / demand clues",
    "competing_solution_mentions": "Competing solution mentions",
}

# Classification groups, in label order.
LABEL_GROUPS = {
    "business_scope": ["business_scope_terms", "small business", "crm", "customer", "admin"],
    "workflow_friction": ["workflow_friction_terms", "workflow", "manual", "scattered", "automation"],
    "practical_tooling": ["practical_tool_terms", "zapier", "n8n", "airtable", "hubspot", "integration"],
    "adoption_barrier": ["adoption_terms", "setup", "onboarding", "permission", "credential", "switching"],
    "dissatisfaction": ["dissatisfaction_terms", "frustrating", "fails", "missing", "slow", "broken"],
    "ai_operational": ["ai_operational_terms", "ai", "llm", "agent", "assistant"],
}

# Cluster buckets, in tie-break order.
BUCKETS = {
    "customer_data_sync_integration": ["crm", "customer", "record", "sync", "field", "api", "integration", "webhook"],
    "workflow_automation_reliability": [
        "workflow", "automation", "zapier", "n8n", "failed", "fails", "error", "troubleshoot",
    ],
    "setup_onboarding_credentials": ["setup", "onboarding", "credential", "permission", "self-host", "configure"],
    "admin_fragmentation_manual_work": [
        "admin", "invoice", "scheduling", "follow-up", "scattered", "manual", "operations",
    ],
    "lean_team_adoption_burden": [
        "small team", "one-person", "solo", "lean team", "without a developer", "maintain",
    ],
    "ai_trust_accuracy": ["ai", "llm", "agent", "assistant", "accuracy", "trust"],
    "product_complexity_switching_cost": [
        "complicated", "complex", "switching", "migration", "too much", "learning curve",
    ],
}
GENERAL_BUCKET = "general_operational_signal"

BUCKET_LABELS = {
    "customer_data_sync_integration": "Customer data sync and integration reliability pain",
    "workflow_automation_reliability": "Workflow automation reliability and troubleshooting pain",
    "setup_onboarding_credentials": "Setup, onboarding, and credential configuration pain",
    "admin_fragmentation_manual_work": "Admin fragmentation and manual follow-up burden",
    "lean_team_adoption_burden": "Lean-team adoption and maintenance burden",
    "ai_trust_accuracy": "AI trust, accuracy, and operational reliability concern",
    "product_complexity_switching_cost": "Product complexity and switching-cost friction",
    "general_operational_signal": "General operational-tool signal",
}
BUCKET_OPPORTUNITIES = {
    "customer_data_sync_integration": "Reliable sync, field mapping visibility, and recovery workflows.",
    "workflow_automation_reliability": "Automation monitoring, clearer failure states, and easier troubleshooting.",
    "setup_onboarding_credentials": "Simpler setup, credential guidance, and onboarding checkpoints.",
    "admin_fragmentation_manual_work": "Unified admin workflows that reduce repeated manual follow-up.",
    "lean_team_adoption_burden": "Low-maintenance tooling for teams without dedicated operators or developers.",
    "ai_trust_accuracy": "Transparent AI behavior, quality checks, and human review controls.",
    "product_complexity_switching_cost": "Lower-friction migration, simpler defaults, and progressive complexity.",
    "general_operational_signal": "Review source evidence before mapping to a product opportunity.",
}

# Tokens that never enter a vector or a top-terms list.
STOP_WORDS = [
    "about", "after", "again", "also", "and", "are", "because", "before", "but", "can",
    "for", "from", "have", "how", "into", "our", "still", "scope", "that", "the", "their",
    "terms", "this", "too", "use", "using", "with", "without",
]

# ---------------------------------------------------------------------------
# End of the fixed values.
# ---------------------------------------------------------------------------

DOMAIN: dict[str, list[str]] = {
    "job": JOB,
    "promotional": PROMOTIONAL,
    "directory": DIRECTORY,
    "conversational": CONVERSATIONAL,
    "quality": QUALITY,
    "remote": REMOTE,
    "remote_job_context": REMOTE_JOB_CONTEXT,
    "company_openings": COMPANY_OPENINGS,
    "customer_voice": CUSTOMER_VOICE,
    "opinion_markers": OPINION_MARKERS,
    "experience_markers": EXPERIENCE_MARKERS,
    "business_scope": BUSINESS_SCOPE,
    "workflow_friction": WORKFLOW_FRICTION,
    "practical_tool": PRACTICAL_TOOL,
    "ai_operational": AI_OPERATIONAL,
    "technical_detail": TECHNICAL_DETAIL,
    "technical_allowance": BUSINESS_SCOPE + WORKFLOW_FRICTION + PRACTICAL_TOOL + TECHNICAL_ALLOWANCE_EXTRA,
    "context_anchor": BUSINESS_SCOPE + WORKFLOW_FRICTION + PRACTICAL_TOOL + CONTEXT_ANCHOR_EXTRA,
    "adoption": ADOPTION,
    "dissatisfaction": DISSATISFACTION,
    "promotion": PROMOTION,
    "generic_enterprise": GENERIC_ENTERPRISE,
    "generic_scope_escape": GENERIC_SCOPE_ESCAPE,
    "quote": QUOTE,
    "cultural_quote": CULTURAL_QUOTE,
    "unmet_need": UNMET_NEED,
    "unmet_need_setting": UNMET_NEED_SETTING,
    "first_person_actors": FIRST_PERSON_ACTORS,
    "pain_actors": PAIN_ACTORS,
    "technical_direct_context": TECHNICAL_DIRECT_CONTEXT,
    "technical_setup_context": TECHNICAL_SETUP_CONTEXT,
    "strong_adoption": STRONG_ADOPTION,
    "strong_dissatisfaction": STRONG_DISSATISFACTION,
    **{f"signal.{name}": terms for name, terms in SIGNALS.items()},
    **{f"label.{name}": terms for name, terms in LABEL_GROUPS.items()},
    **{f"bucket.{name}": terms for name, terms in BUCKETS.items()},
}

MAX_LEXICON_ROWS = 100_000


def all_terms(lexicon: dict[str, list[str]]) -> list[str]:
    """Every distinct term, in first-seen order."""
    return list(dict.fromkeys(term for terms in lexicon.values() for term in terms))


def is_plain_word(term: str) -> bool:
    """Terms of only ``[a-z0-9]`` match whole words; all others match as substrings."""
    return term.isascii() and term.isalnum() and term == term.lower()


def group_names(lexicon: dict[str, list[str]], prefix: str) -> list[str]:
    return [name.removeprefix(prefix) for name in lexicon if name.startswith(prefix)]


def to_table(spark, lexicon: dict[str, list[str]] = DOMAIN, profile: str = "domain") -> DataFrame:
    rows = [(profile, name, i, t) for name, terms in lexicon.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "profile string, name string, ord int, term string")


def from_table(table: DataFrame, profile: str) -> dict[str, list[str]]:
    """Read a profile from a lexicon table. A term list becomes part of every plan as a
    literal, so an oversized table is refused rather than pulled to the driver."""
    rows = table.where(table.profile == profile).orderBy("name", "ord").limit(MAX_LEXICON_ROWS + 1).collect()
    if len(rows) > MAX_LEXICON_ROWS:
        raise ValueError(f"lexicon profile {profile!r} has more than {MAX_LEXICON_ROWS} terms")
    lexicon: dict[str, list[str]] = {}
    for row in rows:
        lexicon.setdefault(row["name"], []).append(row["term"])
    return lexicon
