"""Names, patterns and tables that results must agree with."""

# --- fixed values -----------------------------------------------------------

# Theorem-like environments that share one counter unless a rule says otherwise.
THEOREMS = [
    "theorem", "lemma", "proposition", "corollary", "definition",
    "remark", "example", "claim", "exercise",
]

# Heading levels from outermost to innermost; the list index is the level.
HEADINGS = ["part", "chapter", "section", "subsection", "subsubsection"]

BUILTIN_COUNTERS = HEADINGS + ["equation", "figure", "table", "footnote"]

# A label key: environment, source identifier, optional further scopes.
KEY_PART = r"[^\s:{}\\%#&$^~\x00-\x1f\x7f]+"
KEY_NAME = r"[A-Za-z][A-Za-z0-9._-]*:" + KEY_PART + r"(?::" + KEY_PART + r")*"

# Commands that carry labels and references, and those that carry records too.
NATIVE_MARKER = r"\\(?:label|ref|eqref|nameref)\{[^{}]+\}"
MARKER = r"\\(?:BAHeading|BAFigure|label|ref|eqref|nameref)\{[^{}]+\}"
HEADING_COMMAND = "BAHeading"
FIGURE_COMMAND = "BAFigure"

# Environment tokens; \[ and \] stand for an environment called displaymath.
ENV_TOKEN = r"(?U)(?<!\\)(?:\\(?:begin|end|label)\{[^{}\s]+\}|\\[\[\]])"
ENV_PAIR_TOKEN = r"(?U)(?<!\\)(?:\\(?:begin|end)\{[^{}\s]+\}|\\[\[\]])"
DISPLAY_MATH = "displaymath"
EQUATION_FAMILY = [
    "align", "alignat", "gather", "multline", "eqnarray", "flalign", "displaymath",
]

# Two comment rules that differ on a doubled backslash before the percent sign.
COMMENT_AFTER_NON_BACKSLASH = r"(?<!\\)%[^\n]*"
COMMENT_BY_PARITY = r"(?<!\\)(?:\\\\)*%[^\r\n]*"

# Commands a body or a shared preamble must not contain.
BODY_FORBIDDEN = (
    r"\\(?:input|include|includegraphics|openin|openout|read|write|immediate|special|"
    r"directlua|catcode|csname|usepackage|documentclass|newcommand|renewcommand|def|edef|"
    r"gdef|let|newread|newwrite|endinput|everyjob|loop|repeat|scantokens|RequirePackage|"
    r"InputIfFileExists|IfFileExists)(?![A-Za-z])"
)
PREAMBLE_FORBIDDEN = (
    r"\\(?:input|include|includegraphics|openin|openout|read|write|immediate|special|"
    r"directlua|catcode|csname|documentclass|newread|newwrite|endinput|everyjob|loop|"
    r"repeat|scantokens|InputIfFileExists|IfFileExists)(?![A-Za-z])"
)
MANUAL_NUMBERING = (
    r"\\(?:tag|setcounter|addtocounter|refstepcounter|BATarget|BARef)(?![A-Za-z])"
)

# Comment line that separates source pages in one assembled body.
PAGE_MARKER = r"(?md)^% PDF page (\d+)\r?$"

# Record identifiers, and those that need no renaming.
RECORD_ID = r"[^\s{}\\%]+"
PLAIN_ID = r"[A-Za-z0-9-]+"
ASSET_ID = r"[A-Za-z0-9][A-Za-z0-9_.-]*"

# Boundary alignment tolerates this many characters at the outer edge.
SEAM_SLACK = 8

# File suffixes that belong to a project.
PROJECT_SUFFIXES = [
    ".tex", ".sty", ".cls", ".bib", ".bst", ".bbl", ".bbx", ".cbx", ".def", ".cfg",
    ".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg", ".ttf", ".otf", ".pfb", ".tfm",
    ".map", ".enc", ".ist", ".json", ".csv", ".dat", ".txt", ".lua",
]

# Device names that no portable path may use as a stem.
RESERVED_STEMS = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]

# Limits on automatic repairs, image attempts, diagnostics and previews.
REPAIR_LIMIT = 8
REFERENCE_REPAIR_LIMIT = 6
IMAGE_ATTEMPT_LIMIT = 3
MAX_DIAGNOSTICS = 10
PREVIEW_LENGTH = 300
CONTEXT_CHARS = 100
SNIPPET_BEFORE = 120
SNIPPET_AFTER = 240
NEAR_KEY_COUNT = 5
NEAR_KEY_CUTOFF = 0.6

# Reasons shown for a failed request, by error code.
CAPACITY_REASON = "模型服务繁忙"
FAILURE_REASONS = {
    "RATE_LIMITED": "服务限流或额度不足（HTTP 429）",
    "AUTH_REQUIRED": "模型服务鉴权失败",
    "INVALID_OUTPUT_SCHEMA": "请求格式被服务拒绝",
    "SCHEMA_ERROR": "返回内容格式不符合要求",
    "RESULT_UNKNOWN": "未收到完整结果",
    "REQUEST_FAILED": "模型请求失败",
    "PAUSED": "请求已暂停",
}
OTHER_FAILURE_REASON = "请求失败"
VALIDATION_REASON = "最近一次校验失败"
REVIEW_REASONS = {
    "REPAIR_EXHAUSTED": "本轮自动修复已达上限",
    "DEFERRED": "文献引用待确认，已交给编译阶段",
    "REPAIRING": "校验未通过，正在自动修复",
}
OTHER_REVIEW_REASON = "条目需要处理"

# Task states that override the state derived from calls.
SETTLED_TASK_STATES = [
    "PASSED", "WAITING_MERGE", "DEFERRED", "REPAIR_REQUIRED", "PAUSED", "NEEDS_REVIEW",
]

# Names providers use for the same token counts, in order of preference.
USAGE_INPUT = ["input_tokens", "prompt_tokens", "inputTokens", "promptTokenCount"]
USAGE_OUTPUT = ["output_tokens", "completion_tokens", "outputTokens", "candidatesTokenCount"]
USAGE_CACHED = [
    "cached_input_tokens", "cachedInputTokens", "cachedContentTokenCount", "cache_read_input_tokens",
]

# Compile log: undefined keys, rerun requests, reference problems, file errors.
LOG_UNDEFINED = (
    r"(?i)(?:LaTeX|Package\s+\S+)\s+Warning:\s+(?:Reference|Citation)\s+[`'][^']+'"
    r"[^.]*?\bundefined[^.]*?\."
)
LOG_UNDEFINED_KEY = r"(?i)Warning:\s+(?:Reference|Citation)\s+[`']([^']+)'"
LOG_SUMMARY_WARNING = "LaTeX Warning: There were undefined references."
LOG_RERUN = (
    r"Rerun to get|Please rerun|Label\(s\) may have changed|"
    r"There were undefined references|rerun LaTeX"
)
LOG_REFERENCE = (
    r"LaTeX Warning:.*undefined|Reference .* undefined|Citation .* undefined|"
    r"multiply defined|Undefined control sequence"
)
LOG_FILE_ERROR = r"((?:body|headings|preamble|main)\.tex):(\d+): ([^\r\n]+)"

# Options of an insertion command that compete with a new width.
SIZE_OPTIONS = ["width", "height", "totalheight", "scale", "keepaspectratio"]
# ----------------------------------------------------------------------------

# Collation of titles.
TITLE_COLLATION = "zh_Hans"

# Heading and figure records in a text.
RECORD_MARKER = r"\\(?:BAHeading|BAFigure)\{[^{}]+\}"
