"""Declared schemas, as DDL. Nothing is inferred; a missing value is NULL, meaning unknown."""

from __future__ import annotations

ENTRIES = "raw binary, path string, parent string, name string, kind string, size long, mtime double"
CLASSIFICATION = "raw binary, kind string, encoding string, head_hash string, hash_mode string, sniff_bytes long, note string, classified_at double, sniff_version string"
QUEUE = "raw binary, task string, priority int, state string, attempts int, note string, updated_at double"
MEMBERS = "container binary, member string, size long, kind string"
DERIVED = "task string, key string, text string, meta map<string,string>, cached_at double, chars long"
CHUNKS = "id long, source binary, display string, source_hash string, origin string, cache_task string, cache_key string, byte_start long, byte_end long, derived boolean, engine string, vendored boolean, encoding string"
PAGES = (
    "path string, id string, kind string, name string, title string, summary string, tags array<string>, version int, hash string, status string, "
    "superseded_by string, created timestamp, updated timestamp, access_count int, last_access timestamp, schema_version int, body string"
)
LINKS = "src string, dst string"
TAGS = "page_id string, tag string"
EVENTS = (
    "event string, timestamp double, turn int, role string, content string, query string, context_len long, config map<string,string>, max_turns int, "
    "stdout string, stderr string, final_answer string, warnings array<string>, answer_state struct<content:string,ready:boolean>, scaffold_repaired array<string>, "
    "`index` int, subcall_num int, prompt string, response string, schema string, cached boolean, guardrail string, detail string, verb string, "
    "addresses array<struct<address:string,band:string,alias:string,provenance:string>>, chars long, ok boolean, elapsed_s double, turns_used int, subcalls_used int, forced boolean"
)
METRICS = (
    "kind string, model string, seconds double, started_at string, finished_at string, input_chars long, output_chars long, output_words long, "
    "estimated_output_tokens long, max_tokens int, compression double, groundedness double, boilerplate boolean, cap_hit boolean, empty boolean, error string, "
    "server struct<prompt_tokens:long,predicted_tokens:long,cached_tokens:long,prompt_ms:double,predicted_ms:double>, client_residual_seconds double, torn boolean"
)
META = "key string, value string, written_at double"
#: Version of each declared table; a reader refuses another.
VERSIONS = {"entries": "2", "classification": "1", "queue": "1", "chunks": "1", "pages": "1"}
