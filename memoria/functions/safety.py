"""Input validation, boundary risk and value alignment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that try to take over a prompt, and characters that hide text.
INJECTION = "|".join([
    r"ignore\s+(?:(?:all|previous|above)\s+)*(?:instructions|prompts|rules)",
    r"(?:system|admin|root)\s+(?:override|bypass|disable)",
    r"<\|(?:im_start|im_end|endoftext)\|>",
    r"(?:disregard|forget)\s+(?:previous|all|safety|alignment)",
    r"pretend\s+(?:you|to)\s+(?:are|be)\s+(?:not|no\s+longer)",
    r"jailbreak|dan\s+mode|evil\s+mode",
])
HIDDEN = "[\u200b-\u200d\ufeff]|[\u202a-\u202e]|[\u0300-\u036f]{3,}"
MAX_INPUT = 10_000
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Phrases of actions that are not allowed, by category.
FORBIDDEN = {
    "DANGEROUS_ACTIONS": ["delete system files", "rm -rf", "format drive", "drop database", "truncate table", "shutdown", "kill process", "terminate", "destroy data"],
    "UNAUTHORIZED_ACCESS": ["steal", "hack", "crack password", "bypass security", "exploit vulnerability", "privilege escalation", "social engineering", "phishing"],
    "HARMFUL_CONTENT": ["create malware", "build weapon", "synthesize poison", "harm person", "injure", "violence instructions"],
    "PRIVACY_VIOLATION": ["expose private data", "dox", "reveal personal information", "leak credentials", "share secrets"],
    "DECEPTION": ["impersonate user", "fake identity", "deceive", "hide behavior", "conceal actions", "lie about"],
}
# Words of those phrases that count alone too.
DANGEROUS_WORDS = [
    "delete", "remove", "drop", "truncate", "shutdown", "terminate", "destroy",
    "hack", "crack", "bypass", "exploit", "malware", "weapon",
    "poison", "steal", "harm", "injure", "violence",
    "format", "phishing", "dox",
    "impersonate", "fake", "deceive", "hide", "conceal", "lie",
]
# What an action holds that others must agree to.
CRITICAL = ["delete", "remove", "drop", "truncate", "shutdown", "execute system", "run command", "deploy", "production", "modify security", "change permissions", "grant access"]
SEVERE = ["DANGEROUS_ACTIONS", "HARMFUL_CONTENT", "UNAUTHORIZED_ACCESS"]
THRESHOLDS = {"production": 0.3, "development": 0.7, "sandbox": 0.9}

# Words for and against each value, and what one of them adds or takes.
VALUES = {
    "BENEVOLENCE": (["help", "assist", "improve", "benefit", "protect", "support", "enable", "empower", "serve", "care"], ["harm", "damage", "hurt", "exploit", "abuse", "manipulate", "deceive", "destroy", "undermine"]),
    "PRIVACY": (["protect data", "encrypt", "anonymize", "consent", "secure", "private", "confidential"], ["expose", "leak", "share without consent", "track", "surveil", "spy", "collect secretly"]),
    "TRANSPARENCY": (["document", "log", "report", "disclose", "explain", "audit", "open", "clear"], ["hide", "conceal", "obfuscate", "mislead", "secret", "covert", "undisclosed"]),
    "COLLABORATION": (["together", "team", "coordinate", "share", "sync", "cooperate", "align", "communicate"], ["solo", "ignore team", "override others", "unilateral", "exclude", "isolate", "hoard"]),
    "EXCELLENCE": (["quality", "test", "review", "improve", "best practice", "standard", "thorough", "complete"], ["hack together", "skip tests", "ignore errors", "good enough", "rush", "shortcut"]),
}
FOR, AGAINST = 0.1, 0.15


def watched(forbidden: dict[str, list[str]] = FORBIDDEN) -> dict[str, list[str]]:
    """The phrases of each category and their dangerous words, each once."""
    return {c: list(dict.fromkeys([*phrases, *(w for p in phrases for w in p.split() if w in DANGEROUS_WORDS)])) for c, phrases in forbidden.items()}


def critical_action(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for word in CRITICAL:
        out = out | F.contains(low, F.lit(word))
    return out


def validate(text: Column) -> dict[str, Column]:
    """severity, whether the text is valid, and the text without hidden characters and NULs, cut to MAX_INPUT."""
    hidden = text.rlike(HIDDEN)
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    level = F.greatest(
        F.when(F.length(text) > MAX_INPUT, 2).otherwise(0),
        F.when(F.lower(text).rlike(INJECTION), 3).otherwise(0),
        F.when(hidden, 2).otherwise(0),
        F.when(F.instr(text, "\0") > 0, 2).otherwise(0),
        F.when(special > 0.5, 1).otherwise(0),
    )
    clean = F.substring(F.replace(F.regexp_replace(text, HIDDEN, ""), F.lit("\0"), F.lit("")), 1, MAX_INPUT)
    return {"severity": F.element_at(F.array(*map(F.lit, SEVERITIES)), level + 1), "valid": level == 0, "sanitized": clean}


def boundary_risk(text: Column, forbidden: dict[str, list[str]] = FORBIDDEN) -> dict[str, Column]:
    """Number of forbidden phrases and dangerous words held, their categories, and the risk: 0.8 or 0.6 for the grave ones, else 0.15 each up to 0.5."""
    low = F.lower(text)
    hits = {c: sum(F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in phrases) for c, phrases in watched(forbidden).items()}
    count = sum(hits.values())
    severe = sum(hits[c] for c in SEVERE if c in hits)
    risk = F.when(severe > 0, 0.8).when(hits.get("DECEPTION", F.lit(0)) > 0, 0.6).otherwise(F.least(count * 0.15, F.lit(0.5)))
    names = F.array_compact(F.array(*[F.when(n > 0, F.lit(c)) for c, n in hits.items()]))
    return {"violations": count.cast("long"), "categories": F.array_join(names, ","), "risk": risk}


def value_scores(text: Column, values: dict[str, tuple[list[str], list[str]]] = VALUES) -> dict[str, Column]:
    """A score between 0 and 1 for each value: one half, plus and minus its words."""
    low = F.lower(text)
    held = lambda words: sum(F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words)
    return {v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + held(good) * FOR - held(bad) * AGAINST)) for v, (good, bad) in values.items()}
