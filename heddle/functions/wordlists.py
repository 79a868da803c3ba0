"""Fixed values that scores depend on: word lists, patterns, weights, thresholds."""

# --- fixed values: begin ---
ARCHITECTURE = {
    "mvc": ["model", "view", "controller", "models", "views", "controllers"],
    "repository": ["repository", "repo", "dao", "data_access"],
    "factory": ["factory", "builder", "create"],
    "observer": ["observer", "listener", "subscriber", "event"],
    "strategy": ["strategy", "algorithm", "policy"],
    "adapter": ["adapter", "wrapper", "bridge"],
}
APPROACH = {
    "error_handling": ["try", "catch", "error", "exception", "if err"],
    "data_structures": ["map", "slice", "array", "list", "dict"],
    "patterns": ["interface", "struct", "class", "factory", "builder"],
    "style": ["func", "function", "method", "procedure"],
}
STATE = {
    "immutability": ["const", "readonly", "immutable", "copy"],
    "shared_state": ["global", "static", "shared", "singleton"],
    "state_isolation": ["private", "encapsulated", "local"],
    "state_validation": ["validate", "check", "verify", "assert"],
}
INTERFACES = {
    "interface_definition": ["interface", "protocol", "abstract"],
    "dependency_injection": ["inject", "provide", "wire", "bind"],
    "abstraction": ["implement", "extend", "inherit", "override"],
    "contracts": ["requires", "ensures", "contract", "guarantee"],
}
COORDINATION = {
    "synchronization": ["mutex", "lock", "sync", "atomic", "synchronized"],
    "messaging": ["channel", "queue", "event", "message", "signal"],
    "coordination": ["wait", "notify", "coordinate", "barrier"],
    "isolation": ["goroutine", "thread", "process", "worker"],
}
MODIFICATION = {
    "transaction": ["transaction", "commit", "rollback", "begin"],
    "validation": ["validate", "check", "verify", "ensure"],
    "consistency": ["consistent", "atomic", "ACID", "integrity"],
    "error_recovery": ["recover", "retry", "fallback", "compensate"],
}
MODIFY_WORDS = ["update", "modify", "change", "edit", "alter", "refactor"]
DATA_FLOW = {
    "input_validation": ["validate", "sanitize", "check", "verify"],
    "data_transformation": ["transform", "convert", "map", "filter"],
    "output_formatting": ["format", "serialize", "marshal", "encode"],
    "error_propagation": ["error", "exception", "fail", "panic"],
}
FLOW_STEPS = [["input", "request", "param"], ["process", "handle", "execute"], ["output", "response", "return"]]
COMPATIBILITY = {
    "versioning": ["version", "v1", "v2", "deprecated", "legacy"],
    "adaptation": ["adapter", "wrapper", "bridge", "facade"],
    "migration": ["migrate", "upgrade", "transition", "convert"],
    "deprecation": ["deprecated", "obsolete", "remove", "replace"],
}
COMPATIBILITY_WORDS = ["update", "upgrade", "migrate", "compatibility", "legacy"]
REUSE = {
    "functions": ["func", "function", "def", "method"],
    "modules": ["import", "include", "require", "use"],
    "inheritance": ["extends", "inherit", "implement", "interface"],
    "composition": ["compose", "mixin", "trait", "delegate"],
}
EXTENSION = {
    "interfaces": ["interface", "protocol", "contract"],
    "plugins": ["plugin", "extension", "addon", "module"],
    "hooks": ["hook", "callback", "listener", "event"],
    "factories": ["factory", "builder", "creator", "generator"],
}
CONFIGURABLE = ["config", "setting", "option", "parameter"]
MODULAR = ["module", "component", "service", "package"]
DISRUPTION_WORDS = ["add", "integrate", "extend", "enhance", "modify"]
DISRUPTION = {
    "breaking_changes": ["breaking", "remove", "delete", "replace"],
    "non_breaking": ["add", "extend", "enhance", "backward", "compatible"],
    "isolation": ["separate", "isolate", "encapsulate", "module"],
}
NAME_ROOTS = ["get", "set", "create", "update", "delete", "handle", "process"]
ARCHITECTURE_TERMS = ["middleware", "handler", "controller", "service", "repository", "model", "mvc", "rest", "api", "router", "endpoint", "interface", "struct", "package", "module", "component", "layer", "tier"]
DEPENDENCY_TERMS = ["import", "dependency", "require", "use", "call", "invoke"]
BUSINESS_TERMS = ["user", "customer", "order", "product", "payment", "account", "profile", "create", "update", "delete", "get", "list", "search", "filter", "validate", "process", "calculate", "generate", "send", "receive"]
DATA_TERMS = ["input", "output", "request", "response", "data", "parameter", "return", "result", "json", "xml", "struct", "map", "array", "slice"]
ERROR_TERMS = ["error", "exception", "fail", "invalid", "check", "validate"]
ACTION_TERMS = ["implement", "create", "build", "add", "update", "modify", "delete", "handle", "process", "manage", "execute", "run", "start", "stop"]
TECHNICAL_TERMS = ["http", "json", "api", "rest", "endpoint", "server", "client", "database", "sql", "query", "connection", "session", "cookie"]
REQUIREMENT_VERBS = ["implement", "create", "add", "update", "fix", "analyze"]
VALIDATION_PATTERNS = [r"isinstance\(", r"assert\s+", r"if.*len\(", r"if.*range\(", r"\.isdigit\(", r"\.strip\(", r"re\.match\("]
SECURITY_PRACTICES = {
    "crypto": ["hashlib", "cryptography", "secrets", "bcrypt"],
    "input_sanitization": ["escape", "sanitize", "clean", "validate"],
    "secure_random": ["secrets.", "random.SystemRandom"],
    "sql_injection": ["parameterized", "prepared", "placeholder"],
    "authentication": ["auth", "login", "password", "token"],
}
SECURITY_ISSUES = ["eval(", "exec(", "os.system(", "subprocess.call("]
RESOURCE_PATTERNS = [r"with\s+open\(", r"with\s+.*\(\)\s*:", r"\.close\(\)", r"finally:", r"__enter__", r"__exit__"]
ACQUISITION_PATTERNS = [r"open\(", r"socket\.", r"connect\(", r"cursor\(", r"thread\.", r"process\."]
ASSERTION_PATTERNS = [r"assert\s+", r"assertEqual\(", r"assertTrue\(", r"assertFalse\(", r"expect\(", r"should\."]
TEST_FRAMEWORKS = ["unittest", "pytest", "jest", "mocha", "junit"]
CONFIG_FILES = ["config.yaml", "config.yml", "config.json", "config.ini", "settings.py", ".env", "environment", "docker", "makefile"]
ENVIRONMENT_WORDS = ["os.environ", "getenv", "env.get", "process.env"]
BUILD_FILES = ["setup.py", "requirements.txt", "package.json", "build", "install"]
DEPLOY_WORDS = ["deploy", "install", "setup", "run", "start"]
EFFICIENT_PATTERNS = [r"collections\.deque", r"collections\.defaultdict", r"set\(", r"bisect\.", r"heapq\.", r"itertools\.", r"enumerate\(", r"zip\("]
INEFFICIENT_PATTERNS = [r"\.append\(.*in.*for", r"string.*\+.*in.*for", r"list.*dict\.keys\(\)"]
DESIGN = {
    "factory": ["factory", "create", "builder"],
    "singleton": ["singleton", "_instance", "__new__"],
    "observer": ["observer", "listener", "notify", "subscribe"],
    "strategy": ["strategy", "algorithm", "policy"],
    "decorator": ["decorator", "@", "wrapper"],
    "adapter": ["adapter", "wrapper", "bridge"],
    "mvc": ["model", "view", "controller"],
    "repository": ["repository", "repo", "dao"],
}
OPTIMIZATION_PATTERNS = [r"@lru_cache", r"@cache", r"async\s+def", r"await\s+", r"threading\.", r"multiprocessing\.", r"concurrent\.", r"asyncio\.", r"pool\."]
MODERN = ["fastapi", "flask", "django", "pydantic", "dataclass", "typing", "type:", "->", 'f"', "f'", "pathlib", "path", "json", "requests", "logging", "with open"]
SCALABILITY = ["queue", "pagination", "batch", "chunk", "pool", "cache", "redis", "memcache", "async", "thread", "concurrent", "parallel", "database", "connection", "session", "rate_limit", "throttle", "backoff"]
INTEGRATION = ["api", "endpoint", "route", "rest", "json", "xml", "serialize", "marshal", "http", "request", "response", "client", "server", "service", "interface", "contract", "schema"]
EXTENSIBILITY_PATTERNS = [r"class.*\(.*\):", r"abc\.ABC", r"@abstractmethod", r"plugin", r"hook", r"config", r"setting", r"registry", r"factory"]
STOP_WORDS = ["that", "this", "with", "from", "file", "code", "function", "class", "method", "should", "must", "need", "implement"]
GRADES = [(4.0, "A (Excellent)", "excellent"), (3.0, "B (Good)", "good"), (2.0, "C (Fair)", "fair")]
COVERAGE_RANGES = [("easy", 0.2, 0.4), ("medium", 0.4, 0.6), ("hard", 0.6, 0.8), ("expert", 0.8, 1.0)]
DIFFICULTIES = ["easy", "medium", "hard", "expert"]
CATEGORIES = ["architectural_understanding", "cross_file_refactoring", "feature_implementation", "bug_investigation", "multi_session_development", "code_comprehension", "integration_testing", "security_analysis"]
DIMENSION_WEIGHTS = {"software_engineering": 0.4, "functional_correctness": 0.3, "code_quality": 0.2, "longcontext_utilization": 0.1}
SEVERITY = {"high": 0.3, "medium": 0.2, "low": 0.1}
DIFFICULTY_PRIORITY = {"expert": 4, "hard": 3, "medium": 2, "easy": 1}
CATEGORY_PRIORITY = {"architectural_understanding": 5, "integration_testing": 4, "multi_session_development": 4, "feature_implementation": 3, "code_comprehension": 2, "bug_investigation": 2, "security_analysis": 1, "performance_optimization": 1}
COMPOSITE_WEIGHTS = {
    "architectural_coherence": 0.05,
    "dependency_traversal": 0.05,
    "cross_file_reasoning": 0.05,
    "system_thinking": 0.05,
    "robustness": 0.05,
    "comprehensiveness": 0.05,
    "innovation": 0.05,
    "solution_elegance": 0.05,
    "compilation_success": 0.075,
    "unit_test_performance": 0.075,
    "integration_performance": 0.075,
    "incremental_development": 0.075,
    "security_analysis": 0.067,
    "average_issues": 0.067,
    "code_style": 0.066,
    "information_coverage": 0.05,
    "multi_session_memory": 0.05,
}
SECURITY_RULES = {
    "go": [(r"exec\.Command\(", "high", "Command execution vulnerability"), (r"http\.Get\(", "medium", "Unvalidated HTTP request"), (r"sql\.Query\(", "high", "Potential SQL injection"), (r"fmt\.Sprintf.*%s", "low", "String formatting without validation")],
    "python": [(r"eval\(", "high", "Code injection vulnerability"), (r"exec\(", "high", "Code execution vulnerability"), (r"pickle\.loads?\(", "high", "Unsafe deserialization")],
}
BRANCH_WORDS = {
    "go": ["if ", "for ", "switch ", "case ", "func "],
    "python": ["if ", "for ", "while ", "def ", "class "],
    "javascript": ["if ", "for ", "while ", "function ", "switch "],
}
CODE_PATTERNS = {
    "python": {
        "control": [r"\bif\b", r"\belif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\btry\b", r"\bexcept\b", r"\bfinally\b", r"\bwith\b", r"\band\b", r"\bor\b", r"\bnot\b"],
        "functions": [r"\bdef\s+\w+", r"\blambda\b"],
        "classes": [r"\bclass\s+\w+"],
        "comments": [r"^\s*#"],
    },
    "javascript": {
        "control": [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bswitch\b", r"\bcase\b", r"\btry\b", r"\bcatch\b", r"\bfinally\b", r"&&", r"\|\|", r"!", r"\?.*:"],
        "functions": [r"\bfunction\s+\w+", r"=>", r"\w+\s*:\s*function"],
        "classes": [r"\bclass\s+\w+"],
        "comments": [r"^\s*//", r"/\*.*\*/"],
    },
    "java": {
        "control": [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bswitch\b", r"\bcase\b", r"\btry\b", r"\bcatch\b", r"\bfinally\b", r"&&", r"\|\|", r"!", r"\?.*:"],
        "functions": [r"\b\w+\s+\w+\s*\(", r"\bpublic\s+\w+", r"\bprivate\s+\w+"],
        "classes": [r"\bclass\s+\w+", r"\binterface\s+\w+"],
        "comments": [r"^\s*//", r"/\*.*\*/"],
    },
    "cpp": {
        "control": [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bswitch\b", r"\bcase\b", r"\btry\b", r"\bcatch\b", r"&&", r"\|\|", r"!", r"\?.*:"],
        "functions": [r"\b\w+\s+\w+\s*\(", r"\b\w+::\w+"],
        "classes": [r"\bclass\s+\w+", r"\bstruct\s+\w+"],
        "comments": [r"^\s*//", r"/\*.*\*/"],
    },
    "go": {
        "control": [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bswitch\b", r"\bcase\b", r"\bselect\b", r"&&", r"\|\|", r"!"],
        "functions": [r"\bfunc\s+\w+", r"\bfunc\s*\("],
        "classes": [r"\btype\s+\w+\s+struct", r"\binterface\s*\{"],
        "comments": [r"^\s*//", r"/\*.*\*/"],
    },
}
LANGUAGE_OF_SUFFIX = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "go": "go"}
CORE_FILES = {
    "architectural_understanding": ["main.", "app.", "index.", "server.", "config.", "settings.", "module.", "package.", "__init__.", "Cargo.toml", "package.json", "pom.xml", "build.gradle", "CMakeLists.txt", "Makefile"],
    "cross_file_refactoring": ["service.", "manager.", "handler.", "controller.", "model.", "util.", "helper.", "common.", "shared.", "base."],
    "feature_implementation": ["service.", "api.", "controller.", "handler.", "model.", "entity.", "repository.", "dao.", "interface."],
    "bug_investigation": ["test.", "spec.", "error.", "exception.", "log.", "debug.", "trace.", "monitor."],
    "multi_session_development": ["main.", "app.", "core.", "service.", "model.", "config.", "util.", "common."],
    "code_comprehension": ["readme.", "doc.", "comment.", "main.", "app.", "index.", "core.", "base."],
    "integration_testing": ["test.", "spec.", "integration.", "e2e.", "api.", "service.", "controller.", "client."],
    "security_analysis": ["auth.", "security.", "login.", "password.", "token.", "crypto.", "hash.", "encrypt.", "ssl.", "cert."],
}
RELEVANT_WORDS = {
    "architectural_understanding": ["architecture", "design", "structure", "pattern", "module", "component", "service", "layer", "interface", "abstract"],
    "cross_file_refactoring": ["refactor", "restructure", "service", "manager", "handler", "controller", "utility", "helper", "common", "shared"],
    "feature_implementation": ["feature", "implement", "new", "add", "create", "build", "develop", "api", "endpoint", "functionality"],
    "bug_investigation": ["bug", "error", "exception", "fix", "debug", "issue", "problem", "fault", "defect", "trace"],
    "multi_session_development": ["session", "state", "persistent", "cache", "storage", "memory", "context", "history", "tracking"],
    "code_comprehension": ["documentation", "readme", "guide", "tutorial", "example", "demo", "sample", "overview", "explanation"],
    "integration_testing": ["integration", "test", "spec", "e2e", "api", "client", "mock", "stub", "fixture", "scenario"],
    "security_analysis": ["security", "auth", "authentication", "authorization", "login", "password", "token", "crypto", "hash", "encrypt", "ssl"],
}
EFFORT_WORDS = [(["def ", "function ", "class ", "interface "], 2.0), (["if ", "for ", "while ", "switch ", "case "], 1.0), (["try ", "catch ", "except ", "finally "], 1.0), (["import ", "include ", "require ", "use "], 0.5)]
STANDARD_MODULES = ["os", "sys", "json", "time", "datetime", "collections", "re"]
SUSPICIOUS_IMPORTS = ["__", "sys.exit", "eval", "exec"]
BUILTIN_FUNCTIONS = ["print", "len", "str", "int", "float", "list", "dict", "set", "tuple", "range", "enumerate", "zip", "map", "filter", "sum", "max", "min", "open", "abs", "round", "sorted", "reversed"]
MUTATIONS = ["=", "++", "--", "+=", "-="]
JAVASCRIPT_IMPORTS = [r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"import\s+['\"]([^'\"]+)['\"]"]
GENERIC_IMPORTS = [r"#include\s*[<\"]([^>\"]+)[>\"]", r"using\s+([a-zA-Z_][a-zA-Z0-9_\.]*)", r"import\s+([a-zA-Z_][a-zA-Z0-9_\.]*)"]
PYTHON_IMPORTS = [r"(?m)^\s*import\s+([a-zA-Z_][a-zA-Z0-9_\.]*)", r"(?m)^\s*from\s+([a-zA-Z_][a-zA-Z0-9_\.]*)\s+import"]
GO_IMPORTS = [r"import\s+\"([^\"]+)\"", r"import\s+`([^`]+)`"]
#: kind, name, weight, and the category that alone gets the test
TEST_SUITE = [
    ("compilation", "syntax_validation", 0.3, None),
    ("compilation", "import_resolution", 0.2, None),
    ("compilation", "type_checking", 0.2, None),
    ("compilation", "api_endpoint_structure", 0.3, "feature_implementation"),
    ("compilation", "refactor_consistency", 0.3, "cross_file_refactoring"),
    ("unit", "function_signature_preservation", 0.25, None),
    ("unit", "error_handling", 0.25, None),
    ("unit", "input_validation", 0.25, None),
    ("unit", "output_correctness", 0.25, None),
    ("unit", "bug_fix_verification", 0.4, "bug_investigation"),
    ("unit", "vulnerability_mitigation", 0.4, "security_analysis"),
    ("integration", "module_integration", 0.3, None),
    ("integration", "database_integration", 0.3, None),
    ("integration", "api_integration", 0.4, None),
    ("performance", "execution_time", 0.4, None),
    ("performance", "memory_usage", 0.3, None),
    ("performance", "scalability", 0.3, None),
    ("security", "injection_prevention", 0.3, None),
    ("security", "input_sanitization", 0.3, None),
    ("security", "access_control", 0.4, None),
]
#: category: criteria with their points, weights of the metrics, multipliers of easy, medium, hard, expert
RUBRICS = {
    "architectural_understanding": ({"Pattern Recognition": 20, "Dependency Analysis": 20, "Component Relationships": 20, "Design Principles": 20, "Documentation Quality": 20}, {"ACS": 0.4, "DTA": 0.3, "CFRD": 0.2, "ICU": 0.1}, [1.0, 1.2, 1.5, 2.0]),
    "cross_file_refactoring": ({"Code Quality": 25, "Cross-File Coordination": 25, "Backward Compatibility": 20, "Best Practices": 15, "Testing Integration": 15}, {"CFRD": 0.4, "ACS": 0.3, "IDC": 0.2, "DTA": 0.1}, [1.0, 1.3, 1.6, 2.2]),
    "feature_implementation": ({"Functionality": 30, "Integration": 25, "Error Handling": 20, "Performance": 15, "Documentation": 10}, {"IDC": 0.4, "ACS": 0.3, "ICU": 0.2, "CFRD": 0.1}, [1.0, 1.4, 1.8, 2.5]),
    "bug_investigation": ({"Problem Identification": 30, "Investigation Process": 25, "Code Analysis": 20, "Solution Quality": 15, "Impact Assessment": 10}, {"DTA": 0.4, "CFRD": 0.3, "ICU": 0.2, "ACS": 0.1}, [1.0, 1.3, 1.7, 2.3]),
    "multi_session_development": ({"Session Planning": 25, "Context Retention": 25, "Incremental Progress": 20, "Integration Testing": 15, "Documentation Updates": 15}, {"MMR": 0.5, "IDC": 0.3, "ACS": 0.1, "ICU": 0.1}, [1.0, 1.5, 2.0, 3.0]),
    "code_comprehension": ({"Code Understanding": 30, "Flow Analysis": 25, "Pattern Recognition": 20, "Complexity Assessment": 15, "Documentation Quality": 10}, {"ICU": 0.4, "CFRD": 0.3, "DTA": 0.2, "ACS": 0.1}, [1.0, 1.2, 1.5, 2.0]),
    "integration_testing": ({"Test Coverage": 30, "Test Quality": 25, "Edge Cases": 20, "Test Organization": 15, "Performance Testing": 10}, {"CFRD": 0.4, "ICU": 0.3, "ACS": 0.2, "DTA": 0.1}, [1.0, 1.3, 1.6, 2.2]),
    "security_analysis": ({"Vulnerability Identification": 35, "Risk Assessment": 25, "Remediation": 20, "Best Practices": 15, "Documentation": 5}, {"ICU": 0.4, "ACS": 0.3, "DTA": 0.2, "CFRD": 0.1}, [1.0, 1.4, 1.8, 2.5]),
}
CATEGORY_FOCUS = {
    "architectural_understanding": "system design patterns, component relationships, and architectural decisions",
    "cross_file_refactoring": "code restructuring across multiple files while maintaining functionality",
    "feature_implementation": "adding new functionality that integrates well with existing code",
    "bug_investigation": "systematic debugging, root cause analysis, and problem solving",
    "multi_session_development": "incremental development over multiple sessions with context retention",
    "code_comprehension": "deep understanding of complex code structures and logic",
    "integration_testing": "testing interactions between components and system validation",
    "security_analysis": "identifying security vulnerabilities and implementing security best practices",
}
OTHER_FOCUS = "software development best practices"
AUTH_ERRORS = ["auth", "unauthorized", "forbidden", "invalid api key", "api key", "authentication failed", "credentials", "access denied", "token expired", "expiredtokenexception", "security token", "session token"]
RETRYABLE_ERRORS = ["rate limit", "too many requests", "connection", "timeout", "network", "502", "503", "504", "internal error", "server error", "throttlingexception", "too many tokens"]
THROTTLE_ERRORS = ["throttlingexception", "too many tokens"]
#: first prefix that fits; all other models have TOKEN_LIMIT
TOKEN_LIMITS = [("o1", 100000), ("o3", 100000), ("o4", 100000), ("gpt-5", 128000), ("gpt-4.1", 32768), ("gpt-4o", 16384), ("gpt-4-turbo", 16384), ("gemini-2.5-flash", 65000), ("gemini-2.5-pro", 64000), ("gemini-2.5", 32000)]
TOKEN_LIMIT = 8192
#: level: least and greatest number of files, least and greatest number of tokens
PROJECT_SIZES = {"easy": (0, 15, 10000, 100000), "medium": (15, 40, 100000, 200000), "hard": (40, 80, 200000, 500000), "expert": (80, None, 500000, 1000000)}
RETRIEVAL_LEVELS = ["hard", "expert"]
# --- fixed values: end ---
