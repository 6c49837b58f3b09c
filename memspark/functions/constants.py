"""Weights, tables and limits that results depend on."""

# Fixed values
HYBRID_WEIGHTS = {"semantic": 0.40, "keyword": 0.15, "recency": 0.20, "importance": 0.15, "q": 0.10}
COMPOSITE_WEIGHTS = {"semantic": 0.50, "recency": 0.30, "importance": 0.20}
BM25_K1, BM25_B, MISSING_IDF = 1.5, 0.75, 1.0
DECAY, HALF_LIFE_DAYS, UNKNOWN_RECENCY, PERSISTENT_RECENCY = 0.693, 90, 0.5, 0.4
TYPE_BOOST = {"decision": 1.0, "preference": 0.95, "relationship": 0.9, "insight": 0.9, "commitment": 0.9, "procedure": 0.85, "plan": 0.85, "outcome": 0.85, "fact": 0.8, "action": 0.8, "intention": 0.75, "event": 0.7, "cancellation": 0.6}
OTHER_BOOST = 0.8
PERSISTENT_TYPES = ("decision", "preference", "relationship", "commitment")
STATUS_WEIGHT = {"confirmed": 1.2, "active": 1.0, "outdated": 0.5, "archived": 0.3, "merged": 0.2, "superseded": 0.2, "contradicted": 0.1, "deleted": 0.0}
LIFECYCLE_EDGES = {
    "active": ("confirmed", "outdated", "archived", "contradicted", "merged", "superseded", "deleted"),
    "confirmed": ("outdated", "archived", "superseded", "deleted"),
    "outdated": ("archived", "deleted", "active"),
    "archived": ("active", "deleted"),
    "contradicted": ("deleted", "active"),
    "merged": ("deleted",),
    "superseded": ("deleted",),
    "deleted": (),
}
Q_ALPHA, Q_FLOOR, Q_CEILING, Q_INIT = 0.25, -0.5, 1.0, 0.0
Q_LAYERS = {"action": 0.5, "hypothesis": 0.2, "fit": 0.3}
RERANK_WEIGHTS = {"sim": 0.5, "q": 0.3, "recency": 0.1, "importance": 0.1}
SIM_MEAN, SIM_STD, Z_CLAMP, EPSILON = 0.2, 0.1, 3.0, 0.1
CONTEXTS_KEPT, CONTEXT_CHARS = 5, 120
MISSING_LAYER, VARIANCE_FLOOR = 0.5, 0.01
DEAL_TRANSITIONS = [("negotiation", "won", "deal_closed", 0.8), ("negotiation", "closed", "deal_closed", 0.8), ("delivered", "invoiced", "deal_closed", 0.8), ("invoiced", "paid", "payment_received", 1.0), ("*", "lost", "deal_lost", -0.5), ("*", "cancelled", "deal_lost", -0.5)]
LEAD_TRANSITIONS = [("new", "qualified", "meaningful_response", 0.4), ("qualified", "proposal", "client_yes", 0.6), ("qualified", "negotiation", "client_yes", 0.6), ("proposal", "negotiation", "client_yes", 0.6), ("negotiation", "won", "deal_closed", 0.8), ("negotiation", "closed", "deal_closed", 0.8), ("*", "lost", "deal_lost", -0.5), ("*", "dead", "deal_lost", -0.5)]
CAUSES = ("execution_failure", "strategy_failure", "qualification_failure", "hypothesis_failure", "external", "competition")
ENRICHMENT_TYPES = ("decision", "fact", "event", "insight", "preference", "relationship", "procedure")
MAX_CHUNK_CHARS, CHARS_PER_TOKEN = 800_000, 4
MESSAGE_MIN, MESSAGE_MAX = 10, 5_000
CONDENSED_CHARS = 30_000
MAX_ADJUSTMENTS = 20
MAX_ACTIVE, MAX_CONTENT = 10_000, 10_000
RECALL_AT = (1, 3, 5, 10, 30, 50)

# Words that call for a profile.
PROFILE_WORDS = (
    ("dealflow", ("invoice", "payment", "nda", "pricing", "negotiation", "sow", "billing", "paid", "quote", "інвойс", "оплат", "рахунок", "ціна", "переговор", "акт", "нда")),
    ("sales", ("client", "deal", "lead", "proposal", "outreach", "follow-up", "follow up", "email", "crm", "pipeline", "sales", "prospect", "revenue", "close", "contract", "клієнт", "угода", "лід", "пропозиц", "аутріч", "фоловап", "імейл", "продаж", "контракт", "листа", "написати лист")),
)

# Weights of ratings from 0 to 10.
RATING_WEIGHTS = (0.0, 0.02, 0.05, 0.07, 0.10, 0.12, 0.15, 0.20, 0.25, 0.28, 0.30)
