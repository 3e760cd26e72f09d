"""Word lists, lookup tables, patterns, limits and text formats.

Everything here has to equal the published tool's values for results to agree, so
it is stated plainly in one place. Quotes in patterns are written as \\x22 and \\x27.
"""

# --- fixed values: directories that are never scanned -------------------------------
SKIP_DIRS = {
    "enhanced": ["node_modules", ".git", "__pycache__", "dist", "build", ".next", "coverage", "venv", "env"],
    "fast": ["node_modules", ".git", "__pycache__", "dist", "build", ".next", "coverage", "venv", "env"],
    "detailed": ["node_modules", ".git", "__pycache__", "dist", "build", ".next", "coverage", ".pytest_cache",
                 "venv", "env", ".venv", "out"],
    "core": ["node_modules", "__pycache__", "venv", "env", "build", "dist", "target", ".git", "vendor"],
}

# --- fixed values: extension to language ---------------------------------------------
LANGUAGES = {
    "enhanced": {".js": "javascript", ".mjs": "javascript", ".jsx": "javascript", ".ts": "typescript",
                 ".tsx": "typescript", ".py": "python"},
    "detailed": {".js": "javascript", ".mjs": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx",
                 ".py": "python"},
    "core": {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
             ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".go": "go", ".rs": "rust",
             ".php": "php", ".rb": "ruby", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin"},
}
LANGUAGES["fast"] = LANGUAGES["enhanced"]

# --- fixed values: size limits in characters ------------------------------------------
MAX_CHARS = {"enhanced": 100_000, "core": 100_000, "fast": 50_000, "detailed": None}
PREVIEW_CHARS = 1000
PROMPT_PREVIEW_CHARS = 800

# --- fixed values: snippet length in lines ---------------------------------------------
SNIPPET_LINES = {
    "enhanced": {"express": 8, "nextjs": 10, "python_endpoint": 12, "js_function": 10, "python_function": 12},
    "fast": {"express": 6, "nextjs": 8, "python_endpoint": 8, "js_function": 7, "python_function": 8},
}

# --- fixed values: source patterns (no look-around, so both engines agree) --------------
EXPRESS = r"(?i)(app|router)\.(get|post|put|delete|patch)\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"
NEXTJS = (r"(?i)export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)?\s*"
          r"\([^)]*(?:req|request)[^)]*(?:res|response)[^)]*\)")
FLASK = r"(?i)@app\.route\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27](?:[^)]*methods\s*=\s*\[([^\]]+)\])?"
FASTAPI = r"(?i)@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"
EXPRESS_CORE = r"(?i)(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"
EXPRESS_APP = r"(?i)app\.(get|post|put|delete|patch)\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"
EXPRESS_ROUTER = r"(?i)router\.(get|post|put|delete|patch)\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"
FASTAPI_APP = r"(?i)@app\.(get|post|put|delete|patch)\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"
FASTAPI_ROUTER = r"(?i)@router\.(get|post|put|delete|patch)\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"
DEF_NAME = r"def\s+(\w+)\s*\("
PY_FUNCTION = r"def\s+(\w+)\s*\(([^)]*)\)"
PY_RETURN = r"->\s*([^:]+):"
JS_FUNCTION = (r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?"
               r"(?:function|\([^)]*\)\s*=>))")
JS_PARENS = r"\(([^)]*)\)"
CORE_FUNCTIONS = {
    "python": [r"(?m)^\s*def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?:"],
    "javascript": [r"function\s+(\w+)\s*\(([^)]*)\)", r"\b(\w+)\s*=\s*function\s*\(([^)]*)\)",
                   r"\b(\w+)\s*=\s*\(([^)]*)\)\s*=>", r"async\s+function\s+(\w+)\s*\(([^)]*)\)"],
}
JAVA_FUNCTION = r"(public|private|protected)\s+(?:[\w\s]*\s)?(\w+)\s*\(([^)]*)\)"
JS_IMPORT = r"import.*from\s+[\x22\x27]([^\x22\x27]+)[\x22\x27]"
JS_REQUIRE = r"require\s*\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]\)"
JS_IMPORT_BLOCK = r"import\s+[\s\S]+?\s+from\s+[\x22\x27]([^\x22\x27]+)[\x22\x27]"
PY_FROM = r"from\s+(\w+)"
PY_IMPORT = r"import\s+(\w+)"
PY_FROM_START = r"(?m)^from\s+(\w+)"
PY_IMPORT_START = r"(?m)^import\s+(\w+)"
JAVA_IMPORT = r"(?m)^import\s+([\w.]+);"
CLASS_NAME = r"class\s+(\w+)"
JSX_TAG = r"<(\w+)"
ENV_PATTERNS = [
    r"process\.env\.(\w+)",
    r"os\.environ\.get\s*\(\s*[\x22\x27](\w+)[\x22\x27]",
    r"os\.getenv\s*\(\s*[\x22\x27](\w+)[\x22\x27]",
]
PORT = r"port[:\s=]+(\d+)"
COMPLEXITY_WORD = r"\b(?:if|for|while|try|except)\b"
EXPRESS_PARAM = r":(\w+)"
FLASK_PARAM = r"<(\w+)>"
WAIT_SECONDS = r"try again in ([\d.]+)s"
WAIT_MILLIS = r"try again in ([\d.]+)ms"
NEXTJS_METHODS = ["GET", "POST", "PUT", "DELETE"]

# --- fixed values: dependency names that do not count ------------------------------------
PY_SKIP_DEPS = {"enhanced": ["os", "sys", "json", "re", "time"],
                "core": ["os", "sys", "json", "re", "time", "datetime"]}

# --- fixed values: backend indicators ------------------------------------------------------
BACKEND = {
    "enhanced": {"path": ["api", "server", "route", "controller"],
                 "content": ["express", "fastapi", "flask", "router", "app."]},
    "core": {"path": ["api", "server", "backend", "service", "controller", "route", "model", "handler",
                      "middleware"],
             "content": ["fastapi", "flask", "express", "django", "spring", "@app.route", "app.get", "app.post",
                         "router.", "RestController", "RequestMapping", "GetMapping"]},
}
BACKEND["fast"] = BACKEND["enhanced"]
ELIGIBLE_PATHS = ["server", "api", "service", "controller", "route", "handler", "app.py", "main.py", "app.js",
                  "index.js"]
CONFIG_ENDINGS = [".json", ".config.js", ".md"]
CONFIG_TOKENS = ["config", "package.json", "vite.config", "tailwind.config"]

# --- fixed values: ordered purpose rules (first hit wins) -----------------------------------
PURPOSE_PATHS = {
    "enhanced": [
        (["route", "api", "controller"], "API Routes and Controllers"),
        (["component", "ui", "page"], "UI Components"),
        (["model", "schema"], "Data Models"),
        (["service", "business"], "Business Logic"),
        (["util", "helper"], "Utilities"),
        (["config", "setting"], "Configuration"),
        (["test", "spec"], "Tests"),
    ],
    "detailed": [
        (["route", "api", "controller"], "API Routes and Controllers"),
        (["component", "ui"], "UI Components"),
        (["model", "schema"], "Data Models"),
        (["service", "business"], "Business Logic"),
        (["util", "helper"], "Utilities"),
        (["config", "setting"], "Configuration"),
        (["test", "spec"], "Tests"),
    ],
    "core": [
        (["test", "spec"], "Testing"),
        (["config", "setting"], "Configuration"),
        (["model", "schema"], "Data Model"),
        (["service"], "Business Logic"),
        (["controller", "route", "handler"], "API Controller"),
        (["component"], "UI Component"),
        (["page"], "Page Component"),
        (["util", "helper"], "Utilities"),
        (["middleware"], "Middleware"),
    ],
}
PURPOSE_CORE_CONTENT = [
    (["class.*test", "def test_"], "Testing"),
    (["@app.route", "app.get"], "API Routes"),
    (["class.*model", "basemodel"], "Data Model"),
]
FOLDER_PURPOSE_PATHS = [
    (["route", "api", "controller"], "API Routes and Controllers"),
    (["component", "ui", "view"], "UI Components"),
    (["model", "schema", "entity"], "Data Models and Schemas"),
    (["service", "business", "logic"], "Business Logic Services"),
    (["util", "helper", "lib"], "Utilities and Helpers"),
    (["config", "setting"], "Configuration"),
    (["test", "spec"], "Tests"),
    (["middleware"], "Middleware"),
    (["public", "static"], "Static Assets"),
]
DEFAULT_PURPOSE = "General Purpose"

# --- fixed values: service detection ---------------------------------------------------------
FRONTEND_WORDS = ["react", "vue", "angular", "next"]
BACKEND_FRAMEWORKS = [("express", "Express.js"), ("fastapi", "FastAPI"), ("flask", "Flask"), ("django", "Django")]
INTEGRATIONS = [
    (["mongoose", "sequelize", "prisma", "sqlalchemy"], "Database Integration"),
    (["fetch(", "axios", "requests.", "http."], "External API Calls"),
    (["jwt", "passport", "auth", "login"], "Authentication System"),
]

# --- fixed values: module role and domain (first hit wins) -------------------------------------
MODULE_ROLES = [
    (["frontend", "ui", "client"], "User Interface Layer"),
    (["backend", "api", "server"], "Business Logic Layer"),
    (["data", "model", "db"], "Data Access Layer"),
    (["config", "deploy", "script"], "Infrastructure Layer"),
]
DEFAULT_ROLE = "Core Application Logic"
DOMAINS = [
    (["frontend", "ui", "client", "web", "app"], "frontend"),
    (["backend", "api", "server", "services"], "backend"),
    (["data", "models", "database", "db"], "data"),
    (["config", "deploy", "docker", "scripts"], "infrastructure"),
    (["shared", "common", "utils", "lib"], "shared"),
]
DEFAULT_DOMAIN = "core"

# --- fixed values: ranking -------------------------------------------------------------------------
MAIN_NAMES = ["main", "app", "server", "index"]
HANDLER_NAMES = ["controller", "service", "handler", "route"]

# --- fixed values: import resolution, in order of preference -----------------------------------------
RESOLVE_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".py"]

# --- fixed values: request limits ------------------------------------------------------------------------
TOKENS_PER_MINUTE = 3000
MIN_CALL_SECONDS = 1
MINUTE_REQUESTS = 60
MINUTE_TOKENS = 6000
CORE_MINUTE_REQUESTS = 15
SERVER_ERRORS = [500, 502, 503, 504]
BATCH_FILES = 5
RETENTION_HOURS = 24
KEEP_OUTPUTS = 3

# --- fixed values: text preparation markers -------------------------------------------------------------------
TRUNCATED_MARK = "... [TRUNCATED] ..."
REDUCED_MARK = "... [CONTENT OPTIMIZED FOR API ANALYSIS] ..."
CONTEXT_MARK = "\n// ... [File content optimized for function and API analysis] ...\n"
JS_BODY_MARK = "// ... function body truncated ..."
PY_BODY_MARK = "# ... function body truncated ..."
CONTEXT_ENDPOINTS = "\n// API Endpoints detected:"
REDUCE_LIMIT = 4000
REDUCE_WORDS = ["function ", "def ", "app.", "router.", "export", "class ", "@"]
JS_CONTEXT_WORDS = ["function ", "const ", "let ", "=>", "app.", "router.", "export"]
PY_CONTEXT_WORDS = ["def ", "@app.", "@router.", "class ", "@"]
RESPONSE_SECTIONS = [("SUMMARY:", "summary"), ("API_ENDPOINTS:", "api_endpoints"), ("SETUP_INSTRUCTIONS:", "setup"),
                     ("USAGE_EXAMPLES:", "usage"), ("KEY_FUNCTIONS:", "functions")]

# --- fixed values: technologies -----------------------------------------------------------------------------------
MAJOR_TECHS = [
    ("flask", "Web Framework", "REST API development"),
    ("fastapi", "API Framework", "High-performance APIs"),
    ("firebase", "Backend Service", "Authentication & Database"),
    ("tensorflow", "ML Framework", "Machine Learning"),
    ("opencv", "Computer Vision", "Image Processing"),
    ("react", "UI Library", "Frontend Components"),
    ("next", "React Framework", "Full-stack Development"),
]
# (label, rule kind, tokens): "language" and "exact" compare whole names, "part" looks inside lowered names
TECH_BADGES = [
    ("Python", "language", ["python"]),
    ("JavaScript", "language", ["javascript", "typescript"]),
    ("TypeScript", "language", ["typescript"]),
    ("Flask", "exact", ["flask"]),
    ("FastAPI", "exact", ["fastapi"]),
    ("React", "part", ["react"]),
    ("Next.js", "part", ["next"]),
    ("Firebase", "exact", ["firebase"]),
    ("TensorFlow", "exact", ["tensorflow"]),
    ("Docker", "part", ["docker"]),
]
BACKEND_TECH = [
    ("**Flask**: Web framework for API development", "exact", ["flask"]),
    ("**FastAPI**: Modern, fast web framework for building APIs", "exact", ["fastapi"]),
    ("**Groq**: AI/ML model integration for natural language processing", "exact", ["groq", "Groq"]),
    ("**MediaPipe**: Computer vision for pose detection and tracking", "exact", ["mediapipe"]),
    ("**Firebase**: Authentication and database services", "exact", ["firebase"]),
    ("**TensorFlow**: Machine learning framework", "exact", ["tensorflow"]),
    ("**OpenCV**: Computer vision processing", "exact", ["opencv", "cv2"]),
]
ACKNOWLEDGEMENTS = [
    ("- **Groq** for AI model infrastructure", "exact", ["groq", "Groq"]),
    ("- **Google** for Maps and API services", "part", ["google"]),
    ("- **Firebase** for authentication and database services", "exact", ["firebase"]),
    ("- **MediaPipe** for computer vision capabilities", "exact", ["mediapipe"]),
    ("- **Flask** team for the excellent web framework", "exact", ["flask"]),
    ("- **Next.js** team for the React framework", "part", ["next"]),
]
FEATURES = [
    (["chat", "bot"], "**AI-Powered Conversations**: Advanced chatbot with natural language processing"),
    (["ambulance", "emergency"], "**Emergency Services**: Real-time ambulance location and dispatch system"),
    (["location", "doctor"], "***Healthcare Provider Network**: Find and connect with medical professionals"),
    (["document"], "**Document Processing**: AI-powered document analysis and extraction"),
    (["yoga", "exercise"], "**Wellness Tracking**: Exercise monitoring and pose detection"),
    (["video", "room"], "**Video Consultations**: Real-time video calls and telemedicine"),
    (["appointment"], "**Appointment Management**: Comprehensive scheduling system"),
    (["auth", "login"], "**Secure Authentication**: Multi-factor authentication and user management"),
]
PROJECT_TYPES = [(["healthcare", "medical"], "Healthcare AI Agent"), (["chat", "bot"], "AI Chatbot Platform")]
