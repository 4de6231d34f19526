"""Fixed values. Results depend on these words, patterns and names, so they are stated as they are given, in one place."""

# Words that searches may leave out.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on",
    "with", "he", "as", "you", "do", "at", "this", "but", "his", "by", "from", "they", "we",
    "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their",
    "what", "so", "up", "out", "if", "about", "who", "get", "which", "go", "me", "when",
    "make", "can", "like", "time", "no", "just", "him", "know", "take", "people", "into",
    "year", "your", "good", "some", "could", "them", "see", "other", "than", "then", "now",
    "look", "only", "come", "its", "over", "think", "also", "back", "after", "use", "two",
    "how", "our", "work", "first", "well", "way", "even", "new", "want", "because", "any",
    "these", "give", "day", "most", "us",
)

# Patterns that query sanitising takes out, and its limits.
SQL_PATTERN = r"(?i)\bunion\s+select\b|\bselect\s+.*\s+from\b|\binsert\s+into\b|\bupdate\s+.*\s+set\b|\bdelete\s+from\b|\bdrop\s+(?:table|database)\b|\bcreate\s+(?:table|database)\b|\balter\s+table\b|</?script\b|</?iframe\b|</?object\b|</?embed\b|</?link\b|javascript:|onclick|onload|onerror|;\s*(?:select|insert|update|delete|drop|create|alter)"
COMMAND_PATTERN = r"(?i)\||;|&&|\|\||`|\$\(|<\(|>\(|\$\{|%0a|%0d|%00"
TRAVERSAL_PATTERN = r"\.\./|\.\.\\|\.\.%2f|\.\.%2F|\.\.%5c|\.\.%5C|%2e%2e|%252e%252e"
DIRECTORY_PATTERN = r"\(\)|\\\\|,\s*\w*\s*=|=\s*\w*\s*,"
STRICT_PATTERN = r"(?i)\b(?:select|union|drop|table|insert|update|delete|create|alter)\b"
ENCODED_DOT_PATTERN = r"(?i)%25?2e"
RESERVED_CHARS_PATTERN = "[<>&\"']"
QUERY_BYTES, QUERY_TERMS, TERM_BYTES = 1024, 50, 100

# File names that a path may not have.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")

# Programming languages and the extensions of their files (case matters).
LANGUAGE_EXTENSIONS = {
    "Rust": ("rs",),
    "Python": ("py",),
    "JavaScript": ("js", "jsx", "mjs", "cjs"),
    "TypeScript": ("ts", "tsx", "mts", "cts"),
    "Go": ("go",),
    "Java": ("java",),
    "C++": ("cpp", "cc", "cxx", "c++"),
    "C": ("c", "h"),
    "Ruby": ("rb",),
    "PHP": ("php",),
    "C#": ("cs",),
    "Swift": ("swift",),
    "Kotlin": ("kt", "kts"),
    "Scala": ("scala", "sc"),
    "R": ("r", "R"),
    "Objective-C": ("m", "mm"),
    "Lua": ("lua",),
    "Julia": ("jl",),
    "Dart": ("dart",),
    "Nim": ("nim",),
    "Zig": ("zig",),
    "Elixir": ("ex", "exs"),
    "Clojure": ("clj", "cljs", "cljc"),
    "Haskell": ("hs", "lhs"),
    "OCaml": ("ml", "mli"),
    "F#": ("fs", "fsx", "fsi"),
    "Visual Basic": ("vb",),
    "Pascal": ("pas", "pp"),
    "Perl": ("pl", "pm"),
    "Shell": ("sh", "bash", "zsh", "fish"),
    "PowerShell": ("ps1", "psm1", "psd1"),
    "YAML": ("yml", "yaml"),
    "JSON": ("json",),
    "XML": ("xml",),
    "TOML": ("toml",),
    "SQL": ("sql",),
    "Vue": ("vue",),
    "Svelte": ("svelte",),
}

# Languages that are parsed, by lower-cased extension.
PARSED_EXTENSIONS = {"Rust": ("rs",), "TypeScript": ("ts", "tsx"), "JavaScript": ("js", "jsx", "mjs", "cjs"), "Python": ("py",)}

# What marks a test file.
TEST_DIRECTORIES = ("/test/", "/tests/", "/spec/", "/__tests__/")
TEST_PREFIXES = ("test_", "spec_")
TEST_SUFFIXES = ("_test.rs", "_test.go", "_test.py", "_test.js", "_test.ts", ".test.js", ".test.ts", ".spec.js", ".spec.ts", "_spec.rb", "Test.java", "Tests.java", "Test.cs", "Tests.cs")

# Names of symbols where a program may start.
ENTRY_TYPES = ("function", "method", "constructor")
ENTRY_NAMES = ("main", "Main", "init", "initialize", "start", "run", "execute", "launch", "index", "handler", "serve", "listen", "parse_args", "parse_arguments")
ENTRY_SUFFIXES = ("::main", ".main", "::init", "::start", "::run")
ENTRY_PARTS = ("Route", "Controller", "Command", "Cli")
ENTRY_PREFIX = "test_"

# Directories without sources.
SKIPPED_DIRECTORIES = (
    "target", "node_modules", ".git", ".svn", ".hg", "build", "dist", "out", ".cache", "tmp", "temp", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".idea", ".vscode", ".vs", ".DS_Store", "Thumbs.db", ".tox", ".venv", "venv", "env",
)

# Path prefixes of the graph store.
GRAPH_PREFIXES = ("/symbols/", "/relationships/", "/dependencies/")

# Names of symbol types by their stored code.
SYMBOL_CODES = ("unknown", "function", "method", "class", "struct", "enum", "variable", "constant", "module", "import", "export", "type", "component", "interface", "comment")

# Built-in patterns of code search (case matters).
CODE_PATTERNS = {
    "error_handling": r"(try|catch|Result|Error|panic|unwrap|expect)",
    "async_await": r"(async|await|tokio|futures|spawn)",
    "test_code": r"(#\[test\]|#\[cfg\(test\)]|assert|test_)",
    "todo_comments": r"(TODO|FIXME|HACK|XXX|NOTE)",
    "security": r"(password|secret|key|token|auth|credential)",
}

# Type words by which signatures are indexed.
SIGNATURE_TYPES = ("String", "str", "i32", "u32", "i64", "u64", "f32", "f64", "bool", "Vec", "HashMap", "Result", "Option", "Self")

# Types that are no dependency.
PRIMITIVE_TYPES = ("i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char", "str", "String", "Option", "Result", "Vec", "HashMap", "int", "float", "string", "boolean", "void", "null")

# The plain and the descriptive relation of each kind of reference.
RELATIONS = {
    "function_call": ("calls", "calls"),
    "method_call": ("calls", "calls"),
    "chained_method_call": ("calls", "calls"),
    "static_method_call": ("calls", "calls"),
    "generic_method_call": ("calls", "calls"),
    "turbofish_call": ("calls", "calls"),
    "standard_library_call": ("calls", "calls"),
    "closure_call": ("calls", "calls"),
    "macro_invocation": ("calls", "invokes_macro"),
    "operator_overload": ("calls", "uses_operator"),
    "type_usage": ("references", "uses_type"),
    "field_access": ("references", "accesses_field"),
    "trait_impl": ("implements", "implements_trait"),
    "trait_bound": ("implements", "bound_by_trait"),
    "import": ("imports", "imports"),
    "inheritance": ("extends", "inherits_from"),
    "decorator": ("references", "decorated_by"),
    "function_definition": ("references", "defines_function"),
    "async_call": ("calls", "awaits"),
    "type_annotation": ("references", "annotated_with_type"),
    "pattern_match": ("references", "matches_pattern"),
    "pattern_binding": ("references", "binds_pattern"),
    "context_manager": ("references", "enters_context"),
    "other": ("references", "references"),
}

# The verb and the kind of impact of each relation; then those of relations whose name holds a word.
RELATION_LABELS = {
    "calls": ("Calls", "Function Call Impact"),
    "imports": ("Imports", "Import Impact"),
    "extends": ("Extends", "Inheritance Impact"),
    "implements": ("Implements", "Interface Impact"),
    "references": ("References", "Reference Impact"),
    "returns": ("Returns", "Return Type Impact"),
    "child_of": ("Is child of", "Parent-Child Relationship Impact"),
}
WORD_VERBS = {"uses": "Uses", "contains": "Contains"}
WORD_IMPACTS = {"uses": "Usage Impact", "contains": "Containment Impact", "parameter": "Parameter Impact", "exception": "Exception Impact"}
OTHER_VERB, OTHER_IMPACT = "Has custom relationship with", "Custom Relationship Impact"

# Types of a standard library that a bare name may mean.
STD_TYPES = ("String", "Vec", "HashMap", "Option", "Result")

# What a search suggests and warns of.
SUGGESTIONS = {
    "error": ("Show error recovery patterns", "Find error handling best practices"),
    "test": ("Show related test patterns", "Find testing utilities"),
    "many": ("Narrow search with more specific terms",),
    "none": ("Try broader search terms", "Check for typos in query"),
}
OVER_BUDGET = "Results exceed token budget (%d > %d). Some content may be truncated."
MANY_RESULTS = "Large result set returned. Consider refining query."
