"""Rules, weights, patterns, prices and presets that results depend on."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    category: str
    weight: float
    description: str
    pattern: str
    flags: str = "i"


# Injection rules in order, with ECMAScript patterns.
RULES = (
    Rule("INJ-001", "instruction_override", 0.25, "Ignore previous instructions", r"ignore\s+(all\s+)?(previous|prior|above|earlier|preceding)\s+(instructions?|prompts?|rules?|guidelines?|context)"),
    Rule("INJ-002", "instruction_override", 0.25, "Disregard instructions", r"disregard\s+(all\s+|your\s+)?(previous|prior|above|earlier)\s+(instructions?|context|rules?|guidelines?)"),
    Rule("INJ-003", "instruction_override", 0.25, "Forget instructions", r"forget\s+(everything|all|your)\s+(about\s+)?(instructions?|rules?|training|guidelines?|constraints?)"),
    Rule("INJ-004", "instruction_override", 0.25, "Override instructions", r"override\s+(your|the|all)\s+(instructions?|rules?|safety|guidelines?|constraints?|policies)"),
    Rule("INJ-005", "instruction_override", 0.25, "Do not follow instructions", r"do\s+not\s+follow\s+(your|the|any)\s+(previous|original|initial)\s+(instructions?|rules?|guidelines?)"),
    Rule("INJ-006", "instruction_override", 0.15, "New instructions prefix", r"new\s+(instructions?|rules?|guidelines?)[\s:]+"),
    Rule("INJ-007", "instruction_override", 0.20, "From now on directive", r"from\s+now\s+on[,\s]+(you\s+)?(will|must|should|are|shall)"),
    Rule("INJ-008", "instruction_override", 0.15, "Instead directive", r"instead[,\s]+(you\s+)?(will|must|should|shall)\s+"),
    Rule("ROLE-001", "role_manipulation", 0.25, "You are now [role]", r"you\s+are\s+now\s+(a|an|the|my)\s+"),
    Rule("ROLE-002", "role_manipulation", 0.25, "Pretend to be", r"pretend\s+(you('re|\s+are)\s+|to\s+be\s+)"),
    Rule("ROLE-003", "role_manipulation", 0.20, "Act as [role]", r"act\s+as\s+(a|an|if\s+you\s+were)\s+"),
    Rule("ROLE-004", "role_manipulation", 0.25, "Switch to [X] mode", r"switch\s+to\s+.{0,30}\s+mode"),
    Rule("ROLE-005", "role_manipulation", 0.35, "Enter privileged mode", r"enter\s+(developer|debug|admin|god|sudo|root|jailbreak|DAN)\s+mode"),
    Rule("ROLE-006", "role_manipulation", 0.30, "No restrictions claim", r"you\s+have\s+no\s+(restrictions?|limitations?|rules?|constraints?|filters?)"),
    Rule("ROLE-007", "role_manipulation", 0.35, "DAN jailbreak pattern", r"\bDAN\b.*\b(do\s+anything|no\s+(restrictions?|limits?|filters?))"),
    Rule("EXTRACT-001", "system_prompt_extraction", 0.30, "What is your system prompt", r"what\s+(is|are)\s+your\s+(system\s+)?(prompt|instructions?|rules?|guidelines?|directives?)"),
    Rule("EXTRACT-002", "system_prompt_extraction", 0.30, "Show your prompt", r"show\s+(me\s+)?your\s+(system\s+)?(prompt|instructions?|config(uration)?|rules?)"),
    Rule("EXTRACT-003", "system_prompt_extraction", 0.30, "Repeat your prompt", r"repeat\s+(the|your)\s+(system\s+|initial\s+|original\s+)?(prompt|instructions?|message|rules?)\s*(word\s+for\s+word|verbatim|exactly)?"),
    Rule("EXTRACT-004", "system_prompt_extraction", 0.30, "Output initial prompt", r"output\s+(the|your)\s+(initial|system|original|first)\s+(prompt|instructions?|message)"),
    Rule("EXTRACT-005", "system_prompt_extraction", 0.30, "Print system prompt", r"print\s+(your|the)\s+(system\s+)?(prompt|instructions?|configuration)"),
    Rule("EXTRACT-006", "system_prompt_extraction", 0.30, "Tell me your prompt", r"tell\s+me\s+(your|the)\s+(exact\s+)?(system\s+)?(prompt|instructions?|wording)"),
    Rule("EXTRACT-007", "system_prompt_extraction", 0.30, "Copy paste your prompt", r"copy\s+(and\s+)?(paste|output)\s+(your|the)\s+(system\s+)?(prompt|instructions?)"),
    Rule("ENCODE-001", "encoding_evasion", 0.20, "Decode from encoding", r"(?:decode|translate|convert|interpret)\s+(?:this|the\s+following)\s+(?:from\s+)?(?:base64|rot13|hex|binary|morse|unicode|ascii|url.?encoded)"),
    Rule("ENCODE-002", "encoding_evasion", 0.30, "Execute decoded instructions", r"(?:execute|follow|obey|run)\s+(?:the\s+)?(?:decoded|hidden|encoded|secret)\s+(?:instructions?|commands?|text)"),
    Rule("ENCODE-003", "encoding_evasion", 0.10, "Long Base64 string detected", r"[A-Za-z0-9+/]{50,}={0,2}", ""),
    Rule("DELIM-001", "delimiter_injection", 0.30, "Code block system injection", r"```\s*system\b"),
    Rule("DELIM-002", "delimiter_injection", 0.30, "[SYSTEM] tag injection", r"\[SYSTEM\]"),
    Rule("DELIM-003", "delimiter_injection", 0.30, "<system> tag injection", r"<\/?system>"),
    Rule("DELIM-004", "delimiter_injection", 0.30, "### SYSTEM header injection", r"###\s*(?:SYSTEM|INSTRUCTION|ADMIN|OVERRIDE)"),
    Rule("DELIM-005", "delimiter_injection", 0.35, "ChatML special token injection", r"<\|(?:im_start|im_end|system|endoftext)\|>"),
    Rule("DELIM-006", "delimiter_injection", 0.35, "Llama special token injection", r"\[INST\]|\[\/INST\]|<<SYS>>|<\/s>"),
    Rule("CTX-001", "context_manipulation", 0.20, "Hypothetical no-restrictions", r"(?:imagine|suppose|assume|consider)\s+(?:that\s+)?(?:you\s+(?:are|have|were|can)|there\s+(?:are|is))\s+(?:no\s+)?(?:restrictions?|limitations?|rules?|safety|filters?)"),
    Rule("CTX-002", "context_manipulation", 0.10, "Hypothetical framing", r"(?:in\s+a\s+)?(?:hypothetical|fictional|imaginary|theoretical)\s+(?:scenario|world|situation|context)"),
    Rule("CTX-003", "context_manipulation", 0.10, "Educational purpose claim", r"(?:for\s+)?(?:educational|research|academic|testing|security\s+testing)\s+purposes?\s+only"),
    Rule("CTX-004", "context_manipulation", 0.10, "Test environment claim", r"this\s+is\s+(?:a\s+)?(?:test|simulation|drill|exercise|safe\s+environment)"),
    Rule("OUT-001", "output_manipulation", 0.05, "Format forcing (low risk)", r"(?:respond|reply|answer|output)\s+(?:only\s+)?(?:with|in)\s+(?:json|xml|html|markdown|code|raw)"),
    Rule("OUT-002", "output_manipulation", 0.20, "Suppress safety disclaimers", r"do\s+not\s+(?:mention|include|add|say|output)\s+(?:any\s+)?(?:warnings?|disclaimers?|caveats?|notes?|safety)"),
    Rule("OUT-003", "output_manipulation", 0.25, "Never refuse requests", r"(?:never|don't|do\s+not)\s+(?:refuse|decline|reject|deny|say\s+(?:no|you\s+can't))"),
    Rule("TOOL-001", "tool_abuse", 0.30, "Destructive tool invocation", r"(?:call|execute|run|invoke|use)\s+(?:the\s+)?(?:delete|remove|drop|destroy|wipe|kill|shutdown)[\s_]"),
    Rule("TOOL-002", "tool_abuse", 0.35, "Data exfiltration attempt", r"(?:send|forward|exfiltrate|leak|transmit)\s+(?:all\s+)?(?:the\s+)?(?:data|information|credentials?|secrets?|keys?|tokens?|api.?keys?)\s+(?:to|via|and)"),
    Rule("TOOL-003", "tool_abuse", 0.30, "Credential access attempt", r"(?:access|read|fetch|get|retrieve)\s+(?:the\s+)?(?:env|environment|\.env|secrets?|api.?keys?|credentials?|passwords?|tokens?)"),
)

# Structural signals (pattern, flags, more than, score); text longer than.
NEWLINES = (r"\n", "", 15, 0.05)
HEADERS = (r"^#{1,3}\s", "m", 3, 0.05)
ROLE_MARKERS = (r"\b(system|user|assistant|human|ai|bot|admin)[\s:]", "i", 2, 0.10)
LONG_TEXT = (5000, 0.05)

# Thresholds by strictness, and the part of a threshold that warns.
STRICTNESS = {"low": 0.5, "medium": 0.3, "high": 0.15}
WARN_PART = 0.6


class PiiPattern(NamedTuple):
    type: str
    pattern: str
    confidence: float


# Patterns of personal data in order.
PII_PATTERNS = (
    PiiPattern("iban", r"\b[A-Z]{2}\s?\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2,4}\b", 0.95),
    PiiPattern("credit_card", r"\b(?:\d{4}[\s-]?){3}\d{4}\b", 0.95),
    PiiPattern("german_tax_id", r"\b\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b", 0.70),
    PiiPattern("german_social_security", r"\b\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}\b", 0.75),
    PiiPattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95),
    PiiPattern("phone", r"(?<!\d)(?:\+\d{1,3}|00\d{1,3}|0)\s?[\s\-/]?\(?\d{2,5}\)?[\s\-/]?\d{3,8}[\s\-/]?\d{0,5}\b", 0.80),
    PiiPattern("ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.85),
    PiiPattern("url_with_credentials", r"https?:\/\/[^:\s]+:[^@\s]+@[^\s]+", 0.95),
)


class Preset(NamedTuple):
    name: str
    threshold: float
    injection_action: str
    pii_action: str
    pii_by_key: dict[str, str]
    dangerous: tuple[str, ...]
    max_chain_depth: int
    daily_budget: float
    warn_at_percent: int


# Presets.
PRESETS = {
    p.name: p
    for p in (
        Preset("public_website", 0.25, "block", "mask", {"email": "mask", "phone": "mask", "creditCard": "block", "iban": "block"}, ("delete_*", "remove_*", "drop_*", "destroy_*", "admin_*", "execute_*", "send_email", "payment_*", "transfer_*", "write_*", "create_*", "update_*"), 3, 10.0, 80),
        Preset("internal_support", 0.35, "block", "mask", {"email": "mask", "phone": "mask", "creditCard": "mask", "iban": "mask"}, ("delete_*", "remove_*", "drop_*", "destroy_*", "admin_*", "payment_*", "transfer_*"), 5, 50.0, 70),
        Preset("ops_agent", 0.5, "warn", "mask", {"email": "allow", "phone": "allow", "creditCard": "mask", "iban": "mask"}, ("drop_*", "destroy_*", "wipe_*", "shutdown_*"), 8, 100.0, 60),
    )
}

# Prices in US dollars for a million input and output tokens; order counts.
PRICES = {
    "gpt-5.2": (2.50, 10.0),
    "gpt-5.1": (2.50, 10.0),
    "gpt-5": (2.50, 10.0),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4o": (2.50, 10.0),
    "gpt-4o-mini": (0.15, 0.60),
    "o3": (10.0, 40.0),
    "o3-mini": (1.10, 4.40),
    "o4-mini": (1.10, 4.40),
    "claude-opus-4-6": (15.0, 75.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-haiku-4-5": (0.80, 4.0),
    "gpt-5.2-turbo": (2.50, 10.0),
    "opus": (15.0, 75.0),
    "sonnet": (3.0, 15.0),
    "haiku": (0.80, 4.0),
}
FALLBACK_PRICE = (0.15, 0.60)

# Fields of a request body in order of preference.
BODY_FIELDS = ("message", "input", "prompt", "text", "content", "query")
SKIPPED_METHODS = ("GET", "HEAD", "OPTIONS")
