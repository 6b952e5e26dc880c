"""Every constant whose value decides a result.

Regular expressions are written in Python notation and turned into the JVM's
notation by ``functions.text.jvm_regex``.
"""

# --- fixed values: file extension -> language -------------------------------
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "React JSX", ".ts": "TypeScript",
    ".tsx": "React TSX", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass",
    ".less": "Less", ".java": "Java", ".c": "C", ".cpp": "C++", ".h": "C/C++ Header",
    ".hpp": "C++ Header", ".cs": "C#", ".go": "Go", ".rb": "Ruby", ".php": "PHP",
    ".swift": "Swift", ".kt": "Kotlin", ".rs": "Rust", ".scala": "Scala", ".sh": "Shell",
    ".bash": "Bash", ".sql": "SQL", ".r": "R", ".md": "Markdown", ".json": "JSON",
    ".yaml": "YAML", ".yml": "YAML", ".xml": "XML", ".toml": "TOML", ".dart": "Dart",
    ".lua": "Lua",
}

# --- fixed values: extensions an upload may carry ----------------------------
UPLOAD_EXTENSIONS = [
    "py", "js", "java", "cpp", "c", "h", "hpp", "cs", "php", "rb", "go", "rs", "ts", "swift",
]
MAX_UPLOAD_FILES = 100
MAX_UPLOAD_FILE_BYTES = 5 * 1024 * 1024
MAX_UPLOAD_TOTAL_BYTES = 100 * 1024 * 1024
RETENTION_HOURS = 24

# --- fixed values: repository address ----------------------------------------
REPO_URL = r"github\.com[:/]([^/]+)/([^/]+?)(?:\.git)?$"

# --- fixed values: structure patterns ----------------------------------------
# Any language without rules of its own (MULTILINE).
GENERIC_IMPORT = r"^\s*(import|from|require|using|include|#include)\s+[^\s;]+"
GENERIC_CLASS = r"^\s*(class|interface|struct)\s+(\w+)"
GENERIC_FUNCTION = (
    r"^\s*(def|function|func|fn|sub|procedure|method|var\s+\w+\s*=\s*function"
    r"|const\s+\w+\s*=\s*function|\w+\s*:\s*function|\w+\s*=\s*\([^\)]*\)\s*=>)"
    r"\s*(\w+|\(\s*\))"
)
GENERIC_VARIABLE = r"^\s*(\w+)\s*=\s*[^=]"
COMMENT = r"""^\s*(#|//|/\*|\*|'''|\"\"\").*$"""

# JavaScript and TypeScript (MULTILINE).
JS_IMPORTS = [
    r"import\s+(?:{[^}]+}|\w+|\*\s+as\s+\w+)\s+from\s+['\"]([^'\"]+)['\"]",
    r"import\s+['\"]([^'\"]+)['\"]",
    r"const|let|var\s+\w+\s*=\s*require\(['\"]([^'\"]+)['\"]\)",
]
JS_CLASS = r"class\s+(\w+)(?:\s+extends\s+(\w+))?\s*{"
JS_FUNCTIONS = [
    r"function\s+(\w+)\s*\([^)]*\)",
    r"const|let|var\s+(\w+)\s*=\s*function\s*\([^)]*\)",
    r"const|let|var\s+(\w+)\s*=\s*\([^)]*\)\s*=>",
    r"(\w+)\s*:\s*function\s*\([^)]*\)",
]
JS_COMPONENT = (
    r"(?:export\s+(?:default\s+)?)?(?:const|class)\s+(\w+)"
    r"(?:\s+extends\s+React\.Component|\s+extends\s+Component|\s*=\s*\([^)]*\)\s*=>\s*\{)"
)

# Java.
JAVA_PACKAGE = r"package\s+([\w.]+);"
JAVA_IMPORT = r"import\s+([\w.]+);"
JAVA_CLASS = (
    r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*class\s+(\w+)"
    r"(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{]+))?"
)
JAVA_METHOD = (
    r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*(?:<[^>]+>\s*)?"
    r"(?:[\w.]+)\s+(\w+)\s*\([^)]*\)"
)

# What an import text must look like to name a file.
IMPORT_TARGETS = [
    r"import\s+([^\s,;]+)",
    r"from\s+([^\s,;]+)\s+import",
    r"require\(['\"]\s*([^\s,;'\"]*)['\"]\)",
    r"#include\s+[<\"]([^>\"]+)[>\"]",
]

# --- fixed values: finding rules (type, pattern, message) ---------------------
# Smells run MULTILINE and DOTALL, security rules MULTILINE.
SMELL_RULES = [
    ("long_method",
     r"def\s+\w+\s*\([^)]*\)[^{]*\{[^}]{500,}\}",
     "Method is too long (>500 characters). Consider breaking it down."),
    ("complex_condition",
     r"if\s+[^{:]*?(?:&&|\|\|)[^{:]*?(?:&&|\|\|)[^{:]*?(?:&&|\|\|)",
     "Complex condition with 3+ logical operators. Consider simplifying."),
    ("magic_number",
     r"(?<!\w)(?<!\.)(?<!-)\d{4,}(?!\w)(?!\.)(?!-)(?!\s*[\/\*\+\-])",
     "Magic number detected. Consider using a named constant."),
]
SMELL_SEVERITY = "medium"
MAX_ARGUMENTS = 5
SECURITY_RULES = [
    ("sql_injection",
     r"execute\(\s*['\"][^'\")]*\s*'\s*\+|cursor\.execute\s*\(\s*[^,)]+\s*%\s*[^,)]+\)",
     "Potential SQL injection vulnerability detected. Use parameterized queries."),
    ("command_injection",
     r"os\.system\(\s*[^)]*\+|subprocess\.(?:call|run|Popen)\(\s*[^),]*\+",
     "Potential command injection vulnerability. Avoid string concatenation."),
    ("hardcoded_secret",
     r"(?:password|token|secret|key)\s*=\s*['\"][^'\"]{8,}['\"]",
     "Possible hardcoded secret detected. Use environment variables instead."),
    ("insecure_hash",
     r"hashlib\.(?:md5|sha1)\(",
     "Insecure hash algorithm (MD5/SHA1) detected. Use SHA-256 or better."),
]
SECURITY_SEVERITY = "high"
DEFAULT_CONFIDENCE = "medium"

# --- fixed values: metrics ----------------------------------------------------
DECISION_WORDS = ["if", "for", "while", "switch", "catch"]
COMMENT_STARTS = ["#", "//", "/*", "*"]
INDENT_WIDTH = 4
IDENTIFIER = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"
WORD_PIECE = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)"
SHORT_VARIABLE = r"\b([a-z_]{1,2})\s*="
TOP_CONCEPTS = 10
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don don't
should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't
hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# --- fixed values: suggestions and recommendations ----------------------------
REFACTOR_MESSAGE = ("Consider refactoring complex code sections into smaller, "
                    "more manageable functions.")
NAMING_MESSAGE = ("Consider using more descriptive variable names instead of "
                  "short abbreviations.")
AI_RECOMMENDATIONS = {
    "security": "Implement a security scanning process in your CI/CD pipeline to catch "
                "potential vulnerabilities early.",
    "refactoring": "Consider creating shared utility functions or classes to reduce code "
                   "duplication.",
    "complexity": "Review complex conditional logic throughout the project and consider "
                  "refactoring using strategy pattern or lookup tables.",
    "quality": "Set up linting and code quality tools in your development workflow to maintain "
               "higher code standards.",
}
REVIEW_RECOMMENDATIONS = {
    "documentation": "Improve code documentation by adding more comments and docstrings.",
    "complexity": "Refactor complex functions to improve maintainability.",
    "components": "Consider consolidating similar components to simplify the project structure.",
    "coupling": "Reduce coupling between components to improve modularity.",
    "naming": "Standardize naming conventions across the project for better readability.",
    "testing": "Add unit tests to improve code reliability and facilitate future changes.",
    "security": "Address identified security vulnerabilities as a priority.",
}

# --- fixed values: rows standing in for missing parts -------------------------
OVERRIDE_QUALITY = 70
OVERRIDE_SMELL = ("Code Style", "Consider adding more comments for better readability", 1, "medium")
OVERRIDE_SUGGESTION = ("Add comprehensive documentation to explain the purpose of this file",
                       "medium")
MISSING_QUALITY = 75
MISSING_CYCLOMATIC = 5
MISSING_SUMMARY_TEXT = "Analysis complete."
MISSING_RATING = "unknown"

# --- fixed values: similarity and copies --------------------------------------
SIMILAR_ABOVE = 0.7
SIMILAR_BELOW = 0.99
QUERY_LINES = 10

# --- fixed values: question patterns, in order of trial -----------------------
QUESTION_PATTERNS = [
    ("what", r"what (does|is) ([^?]+)( do| for)?"),
    ("how", r"how (does|is|are) ([^?]+)( work| implemented)?"),
    ("where", r"where is ([^?]+?)( used| called| implemented| defined)?"),
    ("why", r"why (does|is) ([^?]+)"),
    ("list", r"list all ([^?]+)"),
    ("explain", r"explain ([^?]+)"),
    ("compare", r"compare ([^?]+) (?:with|and|to) ([^?]+)"),
]
