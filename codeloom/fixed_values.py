"""Patterns, tables and text formats that results depend on.

All of them are data, not logic. They must stay as they are, since a change of any of
them changes results.
"""

# --- extension -> language group for code chunking ---------------------------------------
LANGUAGE_OF_EXTENSION = {
    ".js": "js", ".ts": "js", ".jsx": "js", ".tsx": "js",
    ".java": "java",
    ".py": "python",
    ".go": "go",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp",
    ".rb": "ruby",
    ".php": "php",
    ".rs": "rust",
    ".scala": "scala",
    ".swift": "swift",
    ".md": "markdown",
    ".html": "html", ".htm": "html", ".xhtml": "html", ".jsp": "html",
    ".tex": "latex",
    ".proto": "proto",
}

# --- chunk sizes ------------------------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
DEFAULT_TOP_N = 10

# --- declaration patterns ---------------------------------------------------------------
IMPORT_LINE = r"(?m)^import\s.+;$"
IMPORT_TARGET = r"(?m)^import\s+.*?['\"](.+?)['\"];?"

TS_TYPE_HEADER = r"^(export\s+)?(type|interface)\s+(\w+)[^=\n]*[=\{]"
TS_TYPE_ENDS = ("}", "export", "type", "interface", "function")
TS_EXPORTED_FUNCTION = r"(?m)^export\s+function\s+(\w+)\s*\([^)]*\)\s*(:\s*[^\{\n]+)?\s*\{"

JAVA_TYPE_HEADER = r"^(\s*)?(public\s+)?(class|interface)\s+(\w+)"
JAVA_OPEN_SIGNATURE = (
    r"^\s*(public\s+)?[\w<>,\[\]]+\s+\w*\s*\([^)]*$|^\s*public\s+\w*\s*\([^)]*$"
)
JAVA_SIGNATURE = (
    r"^\s*(public\s+)?[\w<>,\[\]]+\s+\w+\s*\([^)]*\)\s*[;{]|^\s*public\s+\w+\s*\([^)]*\)\s*[;{]"
)
# own addition: any modifiers, type parameters, generic types with blanks, thrown types
_JAVA_MODIFIER = (
    r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)"
)
_JAVA_TYPE = r"(?:<[^>()]*>\s*)?[\w.]+(?:\s*<[^()=;]*>)?(?:\s*\[\s*\])*"
_JAVA_ANY_HEAD = rf"^\s*(?:{_JAVA_MODIFIER}*{_JAVA_TYPE}\s+|{_JAVA_MODIFIER}+)\w+\s*\("
JAVA_EXTENDED_OPEN_SIGNATURE = _JAVA_ANY_HEAD + r"[^)]*$"
JAVA_EXTENDED_SIGNATURE = _JAVA_ANY_HEAD + r"[^)]*\)\s*(?:throws\s+[\w.,\s]+)?[;{]"
JAVA_SIGNATURE_END = r"[;{]\s*$"
JAVA_ANNOTATION = r"^\s*@"
JAVA_STATEMENT_WORDS = ("return", "else", "new", "throw")

JS_REQUIRE = r"(?m)^const\s+\w+\s*=\s*require\(.+\);$"
JS_COMMENT = r"(?m)(//.*$|/\*[\s\S]*?\*/)"
JS_EXPORTED_FUNCTION = r"(?m)^export\s+function\s+(\w+)\s*\(([^)]*)\)"
JS_EXPORTED_VARIABLE = r"(?m)^export\s+(const|let|var)\s+\w+\s*=.+;$"
JS_MODULE_OBJECT = r"(?m)^module\.exports\s*=\s*\{([\s\S]*?)\};"
JS_MODULE_MEMBER = r"(?m)^(?:module\.)?exports\.(\w+)\s*=.+;$"

JSP_BLOCK = r"<%[=@!]?([\s\S]*?)%>"
HTML_COMMENT = r"<!--([\s\S]*?)-->"
# a quoted attribute value may hold >
HTML_ATTRIBUTES = r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+"
HTML_TAG = rf"<([a-zA-Z][^\s/>]*)({HTML_ATTRIBUTES})>"
# comments, scripts and styles in document order, so that none is looked for inside another
HTML_OPAQUE = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|(<script\b{HTML_ATTRIBUTES}>).*?(?:</script\s*>|\z)"
    rf"|(<style\b{HTML_ATTRIBUTES}>).*?(?:</style\s*>|\z)"
)

# --- predicates -------------------------------------------------------------------------
INSUFFICIENT_ANSWER = (
    r"(?i)not relevant|insufficient context|not enough information"
    r"|cannot answer|need more context"
)
SHORT_CONTENT = 100
LOCAL_SPECIFIER = r"^(\.|/|[A-Za-z]:[\\/])"

# --- free-text sections and history ------------------------------------------------------
SECTION_PATTERNS = {
    "explanation": r"1\.[^\n]*\n([\s\S]*?)2\.",
    "use_case": r"2\.[^\n]*\n([\s\S]*?)3\.",
    "abstraction": r"3\.[^\n]*\n([\s\S]*?)4\.",
    "functions_used": r"4\.[^\n]*\n([\s\S]*)",
}
HISTORY_TAIL = r"## History[\s\S]*$"
HISTORY_HEADING = "## History\n"

# --- text formats ------------------------------------------------------------------------
DEFAULT_TITLE = "Code File"
EMPTY_NOTE = "# No explanation available."
EMPTY_LIST = "(none)"
LIBRARY_SUFFIX = " (library)"
FULL_FILE_PREFIX = "[Full file used for context]\n"
SEARCH_PREFIX = "[Structured regex search used: "
OVERVIEW_HEADING = "# General Overview"
OVERVIEW_INTRO = (
    "This codebase consists of the following researched files and their relationships:"
)
OVERVIEW_CLOSING = (
    "The dependency graph shows how files are interconnected, with arrows indicating import"
    " or usage relationships. Entry file: **"
)
CHAIN_HEADING = "# Code Chain Map"
SUMMARIES_HEADING = "# File Summaries"
MISSING_HEADING = "# Missing Files"
HTML_HEADINGS = ("JSP Blocks:", "HTML Tags:", "Comments:", "Scripts:", "Styles:")

# --- code chunk boundaries, per language group (text before which a piece may start) --------
CODE_BOUNDARIES = {
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ",
           "\nwhile ", "\nswitch ", "\ncase ", "\ndefault "],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ",
             "\nfor ", "\nwhile ", "\nswitch ", "\ncase "],
    "python": ["\nclass ", "\ndef ", "\n\tdef "],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ",
           "\ncase "],
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ",
            "\nwhile ", "\nswitch ", "\ncase "],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ",
             "\nbegin ", "\nrescue "],
    "php": ["\nfunction ", "\nclass ", "\nif ", "\nforeach ", "\nwhile ", "\ndo ",
            "\nswitch ", "\ncase "],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ",
             "\nmatch "],
    "scala": ["\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ",
              "\nwhile ", "\nmatch ", "\ncase "],
    "swift": ["\nfunc ", "\nclass ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ",
              "\ndo ", "\nswitch ", "\ncase "],
    "markdown": ["\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n\n***\n\n",
                 "\n\n---\n\n", "\n\n___\n\n"],
    "html": ["<body>", "<div>", "<p>", "<br>", "<li>", "<h1>", "<h2>", "<h3>", "<h4>",
             "<h5>", "<h6>", "<span>", "<table>", "<tr>", "<td>", "<th>", "<ul>", "<ol>",
             "<header>", "<footer>", "<nav>", "<head>", "<style>", "<script>", "<meta>",
             "<title>"],
    "latex": ["\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\subsubsection{",
              "\n\\begin{enumerate}", "\n\\begin{itemize}", "\n\\begin{description}",
              "\n\\begin{list}", "\n\\begin{quote}", "\n\\begin{quotation}",
              "\n\\begin{verse}", "\n\\begin{verbatim}", "\n\\begin{align}"],
    "proto": ["\nmessage ", "\nservice ", "\nenum ", "\noption ", "\nimport ", "\nsyntax "],
}
