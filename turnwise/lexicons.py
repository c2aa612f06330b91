"""Rule lists. Every job takes its own as a parameter; these are the defaults.

Fixed values: everything in this file must stay as it is for the default results to hold.
"""

# --- session logs -----------------------------------------------------------------------------
CORRECTION = (
    r"(?i)^\s*(no\b|nope|why\b|stop\b|don'?t\b|do not\b|i already|i said|i meant|that's not|wrong|"
    r"huh|wait\b|actually\b|\?\?)"
)
INTERRUPT = "[Request interrupted by user"
PEER = "Another Claude session sent a message"
HOOK = "Stop hook feedback:"
COMMAND = r"<command-name>\s*([^<\s]+)\s*</command-name>"
ANSWER = r'"="([^"]*)"'
DEFAULT_ANSWER = "(Recommended)"
REFUSED = "doesn't want to proceed"
REJECTED = "rejected"
SKILL_TOOL = "Skill"
ASK_TOOL = "AskUserQuestion"
HEADLESS = "sdk-cli"
PRIVATE = "-private-"
MAX_USER_CHARS = 2500
BEFORE_CHARS = 600
TURN_CHARS = 1200
TOOL_CHARS = 120

# --- lenses: the definitions are prose, the word lists are ours --------------------------------
CLAIM = r"(?i)\b(done|fixed|passes|passing|pass now|all tests pass)\b"
RUN_TOOL = r"^(Bash|Task|mcp__\S*(screenshot|browser|preview))"
FETCH_TOOL = r"^(WebFetch|WebSearch|mcp__|Bash (gh|curl|git|jira|linear)\b)"
SEARCH_TOOL = r"^(Grep|Glob|Bash (grep|rg|find|which|git grep|man)\b)"
PASTE = r"(?m)(^Traceback \(most recent call last\)|^\s+at \S+\(|^diff --git |^#+ Done When|^[A-Z]+-\d+\b|\d{2}:\d{2}:\d{2})"
CHECKS = {
    "tests": (r"(?i)\btests? (pass|passed|are green)", r"(?i)\b(pytest|jest|vitest|npm (run )?test|pnpm test|cargo test|go test)\b"),
    "lint": (r"(?i)\blint (is )?(clean|passes|passed)", r"(?i)\b(eslint|ruff|flake8|npm run lint|pnpm lint)\b"),
    "build": (r"(?i)\bbuild (passes|passed|succeeds|succeeded)", r"(?i)\b(npm run build|pnpm build|make|cargo build|tsc)\b"),
}

# --- prose ------------------------------------------------------------------------------------
MAX_WORDS = 25
MAX_STEP_WORDS = 20
MAX_LINES = 100
MAX_PARAGRAPH = 6
BANNED = r"(?i)\b(?:simply|just|powerful|seamless)\b|\b(?:e\.g|i\.e)\.|[\x{1F000}-\x{1FAFF}]|.\x{FE0F}"
SKILL_HEADINGS = ["When to use it", "Example", "Install", "What it does", "Limits", "More"]
MOD_HEADINGS = ["Why", "Install", "Example", "What it does", "Settings", "Limits", "More"]

TELLS = {
    3: r"(?i)\b(highlighting|ensuring|reflecting|showcasing|fostering)\b",
    5: r"(?i)\b(experts believe|industry reports suggest|some critics argue)\b",
    7: r"(?i)\b(additionally|crucial|delve|enduring|enhance|fostering|garner|interplay|intricate|landscape|"
       r"pivotal|showcase|tapestry|testament|underscore|vibrant)\b",
    8: r"(?i)\b(serves as|stands as|boasts|features)\b",
    9: r"(?i)\bnot just\b[^.!?\n]*\bbut\b",
    13: "—",
    17: r"(?m)^#+ +[A-Z][a-z]+(?: +[A-Z][a-z]+)+ *$",
    18: r"[\x{1F000}-\x{1FAFF}]|.\x{FE0F}",
    19: "[‘’“”]",
    20: r"(?i)(i hope this helps|let me know if|\bof course!|\bcertainly!|found the smoking gun)",
    22: r"(?i)(great question!|you're absolutely right)",
    23: r"(?i)\b(in order to|due to the fact that|it is important to note that)\b",
    26: r"(?i)\b(substrate|wedge|vector|locus|vantage|nexus|bedrock|scaffolding|modality|paradigm|gold-plating|"
        r"ratchet|endgame|north star|flywheel)\b",
    31: r"(?i)\b(utilize|leverage|facilitate|numerous|in the event that)\b",
}

# --- notes ------------------------------------------------------------------------------------
CODE_EXTENSIONS = "ts|tsx|js|jsx|mjs|cjs|php|py|rb|go|rs|swift|kt|java|vue|svelte|css|scss|sql|sh|c|h|cpp|cs|ex|exs"
NOTE_RULES = {
    "task state": [
        r"(?i)\b(currently|in progress|this session|today|yesterday|right now|for now|next steps?|todo|wip|"
        r"working on|just (fixed|added|merged|pushed|finished))\b",
    ],
    "one-off reference": [
        r"(?i)\b(pr|pull request|issue)\s*#?\d+\b",
        r"(^|\s)#\d{2,}\b",
        r"(^|[\s(`'\"])claude/[\w.-]+",
    ],
    "repo detail": [
        rf"[\w/-]+\.({CODE_EXTENSIONS}):\d+",
        r"(?m)^\s*```",
    ],
    "short-lived": [
        r"(?i)\b(tomorrow|tonight|this week|next week|last week|this sprint|still pending|is pending|"
        r"pending (a|an|the|client|research|review|approval|input))\b",
        r"(?i)\bbranch\s+`?[\w.-]+/[\w./-]+",
        r"\.claude/(plans|jobs|todos)/|(^|[\s`(])/(private/)?tmp/",
    ],
    "dated status": [
        r"\b20\d{2}-[01]\d-[0-3]\d\b",
        r"(?i)\bas of (19|20)\d{2}\b",
    ],
}
HEX_RULE = "one-off reference"
HEX = r"\b[0-9a-f]{7,40}\b"
MAX_TOPIC = 1200
MAX_INDEX_LINE = 200
NOTE_FOLDER = r"/projects/[^/]+/memory/"
NOTE_INDEX = r"(^|/)MEMORY\.md$"

# --- paths ------------------------------------------------------------------------------------
TOOL_FOLDERS = [
    ".claude", ".agents", ".agent", ".codex", ".cursor", ".gemini", ".grok", ".muse", ".qwen", ".kimi", ".kimi-code",
    ".trae", ".codebuddy", ".comate", ".lingma", ".qoder", ".windsurf", ".devin", ".kiro", ".roo", ".cline",
    ".clinerules", ".continue", ".junie", ".opencode", ".factory", ".augment", ".kilo", ".kilocode", ".github",
    ".vscode", ".idea",
]
ROOT_DOCS = [
    "readme", "claude", "claude.local", "agents", "agents.override", "gemini", "qwen", "codebuddy", "codebuddy.local",
    "warp", "changelog", "contributing", "security", "code_of_conduct", "license", "notice", "llms", "llms-full",
]
WORK_FOLDER_NAMES = ["prototypes", ".scratch", ".recovery", "research_notes"]
WORK_FOLDER_PREFIX = "spike-"
WORK_FOLDER_SUFFIX = ".local"
REPORT_FOLDERS = r"^(reports|docs/(stories|epics|research|perf|qa|implementation|plans|plan|notes))/"
ARTIFACT_FOLDERS = ["artifacts", ".e2e-evidence", "test-results"]
LOOSE_DOC = r"\.(md|html|txt)$"
REPORT_NAMES = [
    r"^\d+-[A-Z][A-Z0-9-]*\.md$",
    r"^\d+-[a-z-]*verification\.json$",
    r"(?i)^(findings|report|summary|scores)\.md$",
    r"-(report|plan|draft)\.md$",
    r"-decisions-[^/]*\.md$",
]
PROBE_NAMES = r"^zz-probe-|^test_zz_|_tmp\.py$"
PATH_REASONS = [
    "a prototype, scratch, recovery, research-notes, spike or .local folder",
    "a reports/ or docs/ planning folder",
    "a test artifact or evidence folder",
    "a loose document at the repo root",
    "a findings, report, plan or numbered evidence file name",
    "a probe or temporary test file name",
]
TEST_NAME = r"\.(test|spec)\.[^/]+$|(^|/)test_[^/]*\.py$|_test\.(py|go)$"
TEST_FOLDERS = ["test", "tests", "__tests__", "e2e", "__snapshots__"]
MIGRATION = (
    r"(^|/)(database/migrations|db/migrate|prisma/migrations|alembic/versions)/|(^|/)drizzle/(meta/|[0-9])|"
    r"(^|/)migrations/[0-9][^/]*\.(ts|js|sql|py|rb)$"
)
PAYLOAD_TERMS = r"(?i)self-verify|Before the PR|PASS verdict|re-run command"
LARGE_WINDOW = "[1m]"
KEEP_DAYS = 1

# --- modes and gates --------------------------------------------------------------------------
MODES = ["readonly", "research", "prototype", "build", "off"]
COMMIT = r"\bgit\s+commit\b"
PUBLISH = r"\bgit\s+push\b|\bgh\s+pr\s+(create|merge)\b"
API_CALL = r"\bgh\s+api\b"
PULLS = r"/pulls\b"
API_WRITE = r"(?i)(?:-X|--method)[\s=]*(?:POST|PATCH|PUT|DELETE)\b|\s(?:-f|-F|--field|--raw-field|--input)(?=[\s=]|$)"
API_GET = r"(?i)(?:-X|--method)[\s=]*GET\b"
TRACKER_CLI = (
    r"\bgh\s+(issue|project|label|milestone)\s+(create|edit|close|reopen|delete|comment|transfer|item-add|item-edit|"
    r"item-archive|field-create|link)\b|\bgh\s+api\b.*(-X|--method)\s*(POST|PATCH|PUT|DELETE)\b|"
    r"\bacli\s+jira\s+\S+\s+(create|edit|delete|transition|assign|comment|link)\b"
)
WRITE_VERBS = [
    "create", "save", "update", "delete", "add", "remove", "set", "edit", "write", "post", "move", "archive", "close",
    "reopen", "assign", "link", "unlink", "merge", "upsert", "patch", "put", "push", "transition", "submit", "publish",
    "batch",
]
HOST_TOOLS = r"^mcp__ccd_(turn|view|window|sidebar)__"
PLAN_FILE = r"(?i)\.(md|markdown)$"
WORK_FILE = r"(^|[\\/])\.claude[\\/]work[\\/]"
ARTIFACT_READS = ["read", "list", "quickstart", "open", "pin", "unpin"]
EDIT_TOOLS = ["Edit", "Write", "NotebookEdit"]
HARMLESS_REDIRECT = r"\d*>&\d+|\d*>>?\s*/dev/null"
REDIRECT_TARGET = r">>?\s*([^\s>&|;]+)"
PART_SPLIT = r"&&|\|\|?|;|\n"
TRACKER_WRITES = [
    "save_issue", "save_comment", "save_document", "save_project", "save_milestone",
    "save_initiative", "save_initiative_label", "save_issue_label", "save_project_label",
    "save_release", "save_release_note", "save_status_update", "save_diff_comment",
    "create_attachment", "create_attachment_from_upload", "create_issue_label",
    "create_initiative_label", "delete_attachment", "delete_comment", "delete_diff_comment",
    "delete_status_update", "merge_diff", "update_diff", "submit_diff_review",
    "resolve_diff_thread", "retire_issue_label", "retire_initiative_label",
    "retire_project_label", "restore_issue_label", "restore_initiative_label",
    "restore_project_label", "share_issue", "unshare_issue", "mark_notification",
]
TRACKER_SERVER = "linear-server"
TRACKER_SERVER_WRITE = r"^(save|delete|create|update|merge|submit|resolve|retire|restore|share|unshare|mark)_"
DRASTIC_NAME = r"^(delete|retire)_"
CANCEL_STATES = ["canceled", "cancelled"]
SHIFT_START = "09:00"
SHIFT_END = "18:00"
MINUTES = r"^([01]\d|2[0-3]):([0-5]\d)$"
CALL_FAILED = r'"success"\s*:\s*false'

# --- code blocks ------------------------------------------------------------------------------
SCRIPT_FILE = r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$"
PYTHON_FILE = r"\.py$"

# --- tests and reviews ------------------------------------------------------------------------
WEAK_ASSERTIONS = {
    "truthy": r"\btoBeTruthy\(",
    "defined": r"\btoBeDefined\(",
    "no throw": r"\bnot\.toThrow\(",
    "any snapshot": r"\btoMatch(Inline)?Snapshot\(\s*\)",
    "internal mock": r"\b(jest|vi)\.mock\(\s*['\"]\.{1,2}/",
}
PROOF_LEVELS = ["stated", "pointed at the line", "walked through", "run"]
SEVERITIES = ["broken", "ugly", "fragile"]
TRIAGE_STATES = ["needs-triage", "needs-info", "ready-for-agent", "ready-for-human", "wontfix"]
TRIAGE_CATEGORIES = ["bug", "enhancement"]
NEEDS_PERSON = {
    "merge first": r"(?i)\bmerge[sd]? to (the )?main\b",
    "sign-in": r"(?i)\bsign[- ]?in\b|\blog ?in\b",
    "secret": r"(?i)\bsecret\b|\bapi key\b|\btoken\b",
    "device": r"(?i)\breal device\b|\bphysical device\b",
    "console": r"(?i)\bvendor console\b|\bdashboard\b",
    "payment": r"(?i)\bpaid account\b|\bpayment\b",
    "taste": r"(?i)\btaste\b|\blooks right\b",
}

# --- usage ------------------------------------------------------------------------------------
RATE_WINDOWS = {  # name: (window, least elapsed, red gap) in seconds
    "five_hour": (18_000, 1_800, 1_800),
    "seven_day": (604_800, 43_200, 86_400),
}
CI_FAIL = ["FAILURE", "ERROR", "TIMED_OUT", "CANCELLED", "ACTION_REQUIRED", "STARTUP_FAILURE"]
CI_OPEN_CONCLUSION = ["", "PENDING", "EXPECTED"]
CI_OPEN_STATUS = ["IN_PROGRESS", "QUEUED", "PENDING", "WAITING", "REQUESTED"]
INSTRUCTION_LIMIT = 150_000

# --- motion -----------------------------------------------------------------------------------
DURATION_BANDS = {  # kind: (least, most) in milliseconds
    "press": (100, 160),
    "tooltip": (125, 200),
    "dropdown": (150, 250),
    "modal": (200, 500),
}
STAGGER_MS = (30, 80)
CURVES = {
    "linear": (0.0, 0.0, 1.0, 1.0),
    "ease": (0.25, 0.1, 0.25, 1.0),
    "ease-in": (0.42, 0.0, 1.0, 1.0),
    "ease-out": (0.0, 0.0, 0.58, 1.0),
    "ease-in-out": (0.42, 0.0, 0.58, 1.0),
}
STILL_SECONDS = 3.0
