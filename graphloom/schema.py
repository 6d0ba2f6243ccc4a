"""Fixed relations, enumerations and constants of the engine."""

from __future__ import annotations

# Enumerations, stored as lower-snake strings.
SYMBOL_KINDS = ("function", "class", "method", "interface", "route", "module", "var", "const")
EDGE_KINDS = ("calls", "imports", "inherits", "implements", "reads", "writes", "routes_to", "tests")
PARSE_STATUS = ("ok", "partial", "failed")
PUBLISH_REASONS = ("initial", "incremental", "reconcile", "full", "reembed")
ARTIFACT_LANGUAGES = ("yaml", "toml", "sql", "html", "markdown")
CALLABLE_KINDS = ("function", "method", "route")

# Limits and weights.
RRF_K = 60
ALPHA, EPSILON = 0.15, 1e-5
IMPACT_ALPHA, COMPLEXITY_ALPHA = 0.15, 0.10
FAN_OUT, AMBIGUOUS_BELOW = 8, 0.6
SUBGRAPH_NODES, SEED_DEPTH = 96, 25
EXCERPT_BYTES, ARTIFACT_CHARS, ARTIFACT_LEAVES = 1500, 4096, 10_000
FUZZY_NAMES, CANDIDATES = 256, 256
QUEUE_CAP, DRAIN_BUDGET, PENDING_FILES = 4096, 64, 8
BACKOFF_MS = (1000, 5000, 30_000, 300_000)
IGNORED_DIRS = ("node_modules", ".git", "dist", "target", "__pycache__", ".venv", "reference")
GAMMA_STRUCTURAL = {"calls": 0.95, "inherits": 0.90, "implements": 0.85, "routes_to": 0.95, "tests": 1.0, "reads": 0.80, "writes": 0.80, "imports": 0.45}
GAMMA_COMPLEXITY = {"calls": 1.0, "routes_to": 1.0, "tests": 0.8, "inherits": 0.5, "implements": 0.5, "reads": 0.6, "writes": 0.6, "imports": 0.05}
STOP_CALLS = (
    "if", "else", "for", "foreach", "while", "do", "switch", "case", "catch", "try", "finally", "return", "throw", "throws", "new", "delete",
    "sizeof", "typeof", "instanceof", "await", "yield", "assert", "lock", "using", "when", "with", "match", "synchronized", "super", "this", "self",
)

SYMBOL = (
    "id string, kind string, name string, qualified_name string, language string, module string, file_path string, line_start int, line_end int, "
    "signature string, docstring string, content_hash string, body_excerpt string, semantic_summary string, risk_score double, ambiguous boolean, "
    "untrusted_flags array<string>, updated_at bigint"
)
EDGE = "src_id string, dst_id string, kind string, confidence double, meta struct<dst_missing:boolean,ambiguous:boolean,loop_depth:int>"
FILE = "path string, language string, size_bytes bigint, content_hash string, parsed_at bigint, parse_status string"
ATTRIBUTE = "symbol_id string, key string, value string"
VECTOR = "symbol_id string, embedding array<float>"
QUEUE = "symbol_id string, file_path string, enqueued_at bigint, attempts int, next_attempt_at bigint, last_error string"
TABLES = {"symbol": SYMBOL, "edge": EDGE, "file": FILE, "symbol_attribute": ATTRIBUTE, "symbol_vec": VECTOR, "embedding_queue": QUEUE}
KEYS = {"symbol": ("id",), "edge": ("src_id", "dst_id", "kind"), "file": ("path",), "symbol_attribute": ("symbol_id", "key", "value"), "symbol_vec": ("symbol_id",), "embedding_queue": ("symbol_id",)}
