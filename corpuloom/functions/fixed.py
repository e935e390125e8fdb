"""Lists, limits and patterns that results depend on."""

from __future__ import annotations

# --- Fixed values. Paths that arrived with something else.
VENDORED_MARKERS = (
    "node_modules/", "site-packages/", "dist-packages/", "/.git/", "/.svn/",
    "/vendor/", "/vendors/", "/third_party/", "/thirdparty/", "/external/",
    "/bower_components/", "/.venv/", "/venv/", "/dist/", "/build/", "/target/",
    "/__pycache__/", "/.tox/", "/.cache/", "/pods/", "/carthage/",
    "/packages/", "/.gradle/", "/.m2/", "/.npm/", "/.cargo/", "/.rustup/",
    "/appdata/", "/program files", "/windows/", "/usr/lib/", "/usr/share/",
)
DOCUMENTATION_MARKERS = (
    "/docs/", "/doc/", "/documentation/", "/manual/", "/help/", "/man/",
    "/readme", "readme.", "changelog", "changes.", "license", "licence",
    "copying", "notice", "authors", "contributing", "install.", "todo.",
    "/examples/", "/example/", "/samples/", "/tutorial", "/guide",
)
# --- Fixed values. File name endings by what they hold.
MARKUP_ENDINGS = (".htm", ".html", ".xhtml", ".xml", ".xsl", ".xsd", ".dtd", ".css", ".scss", ".less", ".svg", ".rss", ".atom", ".mht")
CODE_ENDINGS = (
    ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".py", ".pyi", ".rb", ".pl", ".pm", ".php", ".java", ".kt", ".scala", ".c", ".h", ".cc", ".cpp",
    ".cxx", ".hpp", ".cs", ".go", ".rs", ".swift", ".m", ".mm", ".lua", ".sh", ".bash", ".zsh", ".fish", ".bat", ".cmd", ".ps1", ".sql", ".r",
    ".jl", ".dart", ".ex", ".exs", ".erl", ".clj", ".vb", ".asm", ".f", ".f90", ".pas", ".groovy", ".gradle", ".cmake", ".mk",
)
DATA_ENDINGS = (
    ".json", ".jsonl", ".ndjson", ".geojson", ".csv", ".tsv", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".properties", ".lock", ".map",
    ".po", ".reg", ".plist", ".resx", ".rc", ".strings",
)
PROSE_ENDINGS = (".txt", ".text", ".md", ".markdown", ".rst", ".org", ".adoc", ".asc", ".tex", ".rtf")
# --- Fixed values. Endings of text that is no prose: code, markup and data, sidecars of media and machine output.
NON_PROSE_ENDINGS = (
    ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".py", ".pyi", ".rb", ".pl", ".pm", ".php", ".java", ".kt", ".scala", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".cs",
    ".go", ".rs", ".swift", ".m", ".mm", ".lua", ".sh", ".bash", ".zsh", ".fish", ".bat", ".cmd", ".ps1", ".psm1", ".sql", ".r", ".jl", ".dart", ".ex", ".exs", ".erl", ".clj",
    ".vb", ".asm", ".s", ".f", ".f90", ".pas", ".groovy", ".gradle", ".cmake", ".mk",
    ".html", ".htm", ".xhtml", ".xml", ".xsl", ".xsd", ".dtd", ".css", ".scss", ".less", ".json", ".jsonl", ".ndjson", ".geojson", ".yaml", ".yml", ".toml", ".ini", ".cfg",
    ".conf", ".properties", ".env", ".lock", ".csv", ".tsv", ".map", ".po", ".pot", ".reg", ".desktop", ".service", ".plist", ".strings", ".resx", ".rc",
    ".srt", ".vtt", ".ass", ".ssa", ".sub", ".sbv", ".idx", ".m3u", ".m3u8", ".pls", ".cue", ".nfo", ".sfv", ".log", ".gcode", ".dxf", ".svg", ".pgm", ".pbm", ".hex",
    ".srec", ".dbf", ".diff", ".patch", ".lst", ".sum", ".md5", ".sha1", ".sha256",
)
CODE_PUNCTUATION = "{}[]<>();=*/\\|&$#@`~^_%"
PROSE_FLOOR = 0.62
# --- Fixed values. Words of a question that carry nothing, English and Spanish.
QUESTION_STOPWORDS = tuple(
    "a an and are as at be by did do does for from had has have how in is it its of on or that the their there these they this to was "
    "were what when where which who whom why will with you your "
    "cual cuando de del donde el ella ellas ellos en es esta este esto fue hay la las lo los mas no para por que quien se sin su sus un una "
    "uno y ya".split()
)
STRONG_SHARE = 0.6
# --- Fixed values. Words of a summary that carry no subject.
SUMMARY_STOPWORDS = tuple(
    "about above after again against also among because been before being below between both does doing down during each either from further "
    "have having here into itself just list more most only other over same should some such than that their them then there these they this "
    "those through under until very were what when where which while with within without would your".split()
)
SUBJECT_LETTERS = 4
#: Outer characters that are no part of a summary's word.
WORD_EDGES = ".,;:!?()[]{}<>\"'`*#"
# --- Fixed values. Phrases of a reply that describes nothing.
BOILERPLATE = (
    "as an ai", "i cannot", "i can't", "i'm sorry", "i am sorry", "unable to", "the provided text", "the given text", "no content",
    "does not contain any", "cannot summarize", "cannot summarise", "no text was provided", "empty document",
)
# --- Fixed values. Full-text search.
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
MATCH_TERMS, HIDDEN_CAP, DERIVED_PASS_K = 16, 200, 3
CHUNK_BYTES, CHUNK_MAX_BYTES, READ_BYTES = 1200, 8000, 4096
# --- Fixed values. Addresses of byte ranges.
ADDRESS = r"^(.+?)#L(\d+)-(\d+)$"
ADDRESS_IN_TEXT = r"#L\d+-\d+"
ADDRESS_TOKEN = r"[^\s`\"'()\[\]<>]+#L\d+-\d+"
USAGE_ADDRESS = r"[^\s,\[\]()\"']+#L\d+-\d+"
# --- Fixed values. Limits.
FIND_LIMIT = 200
MEMBER_LIMIT = 20_000
ARCHIVE_HEAD = 600
