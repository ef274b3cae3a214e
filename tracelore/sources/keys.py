"""The keys of the model: (label, property) pairs that must be unique and filled."""

from __future__ import annotations

# Memory, enrichment and sales keys.
MEMORY_KEYS = (
    ("Project", "id"), ("Session", "session_id"), ("SessionEvent", "event_id"), ("Learning", "id"), ("SystemPrompt", "name"), ("ProjectProcessing", "id"),
    ("SystemPromptVersion", "id"), ("SystemPromptInjection", "injection_id"), ("Observation", "id"), ("UserProfile", "name"), ("UserProfileVersion", "id"),
    ("Skill", "id"), ("SkillVersion", "id"), ("TaskPattern", "id"), ("SkillProposalAudit", "id"), ("User", "id"), ("UserProfile", "user_id"),
)
ENRICHMENT_KEYS = (
    ("Turn", "id"), ("ToolCall", "id"), ("ToolResult", "id"), ("Tool", "id"), ("ToolRationale", "id"), ("Resource", "id"), ("EventEnrichment", "id"),
)
SALES_KEYS = (("Account", "id"), ("Account", "slug"), ("Product", "sku"), ("Contact", "contact_id"), ("CSM", "name"))
MODEL_KEYS = MEMORY_KEYS + ENRICHMENT_KEYS + SALES_KEYS
