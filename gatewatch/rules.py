"""Fixed values of the rule set: patterns, word lists, score tables and texts.

Everything in this module is data that has to stay exactly as it is for results
to be comparable between deployments.  Code that interprets it lives elsewhere.
Patterns are written in Python ``re`` syntax; ``functions.regex`` turns them into
the Java dialect Spark uses.
"""

# --- fixed values: suspicious request patterns (type, pattern, ignore case) ---
SUSPICIOUS_PATTERNS = [
    ("sql_injection", r"union.*select", True),
    ("sql_injection", r"drop.*table", True),
    ("sql_injection", r"insert.*into", True),
    ("sql_injection", r"delete.*from", True),
    ("sql_injection", r"update.*set", True),
    ("sql_injection", r"exec.*xp_", True),
    ("xss", r"<script", True),
    ("xss", r"javascript:", True),
    ("xss", r"onerror=", True),
    ("xss", r"onload=", True),
    ("xss", r"onclick=", True),
    ("path_traversal", r"\.\./", False),
    ("path_traversal", r"\\.\\.\\", False),
    ("path_traversal", r"%2e%2e%2f", True),
    ("path_traversal", r"%2e%2e/", False),
    ("path_traversal", r"..%2f", False),
    ("command_injection", r";\s*(cat|ls|pwd|id|whoami)", True),
    ("command_injection", r"\|\s*(cat|ls|pwd|id|whoami)", True),
    ("command_injection", r"`.*`", False),
    ("command_injection", r"\$\(.*\)", False),
    ("file_inclusion", r"\.\./", True),
    ("file_inclusion", r"/etc/passwd", True),
    ("file_inclusion", r"/etc/shadow", True),
    ("file_inclusion", r"php://filter", True),
    ("file_inclusion", r"data://", True),
]

# --- fixed values: default first-match rules (type, enabled, patterns) --------
DEFAULT_ATTACK_RULES = [
    ("sql_injection", True, ["union.*select", "drop.*table", "insert.*into"]),
    ("xss", True, ["<script", "javascript:", "onerror="]),
    ("path_traversal", True, [r"\.\./", "\\.\\.\\"]),
]

# --- fixed values: threat patterns, all case-insensitive ----------------------
THREAT_PATTERNS = [
    ("sql_injection", [
        r"('|(\-\-)|(;)|(\||\|)|(\*|\*))",
        r"(union|select|insert|delete|update|drop|create|alter|exec|execute)",
        r"(script|javascript|vbscript|onload|onerror|onclick)",
    ]),
    ("xss", [
        r"<script[^>]*>.*?</script>",
        r"javascript:",
        r"on\w+\s*=",
        r"<iframe[^>]*>",
    ]),
    ("directory_traversal", [r"\.\./", r"\.\.\\", r"%2e%2e%2f", r"%2e%2e%5c"]),
    ("command_injection", [
        r"(;|\||&|`|\$\(|\$\{)",
        r"(cat|ls|pwd|whoami|id|uname|ps|netstat|ifconfig)",
        r"(rm|mv|cp|chmod|chown|kill|killall)",
    ]),
]

# --- fixed values: user agents ------------------------------------------------
BOT_WORDS = [
    "bot", "crawler", "spider", "scraper", "googlebot", "bingbot", "slurp",
    "duckduckbot", "baiduspider", "yandexbot", "facebookexternalhit",
]
FEATURE_BOT_WORDS = ["bot", "crawler", "spider"]
TOOL_WORDS = [
    "sqlmap", "nikto", "nmap", "masscan", "zap", "burp", "w3af", "acunetix",
    "nessus", "python-requests", "curl", "wget", "libwww",
]

# --- fixed values: paths that scanners look for -------------------------------
SENSITIVE_PATHS = [
    "/admin", "/administrator", "/wp-admin", "/phpmyadmin", "/config", "/backup",
    "/test", "/dev", "/api", "/.env", "/.git", "/robots.txt", "/sitemap.xml",
]

# --- fixed values: character classes ------------------------------------------
PAYLOAD_SPECIALS = "&=?#<>\"'()[]{}|;"
FEATURE_SPECIALS = "!@#$%^&*()+={}[]|\\:;\"<>?"

# --- fixed values: thresholds of the per-address rules ------------------------
BAN_RULES = {
    "not_found_threshold": 20,
    "time_window_minutes": 10,
    "requests_per_minute": 60,
    "requests_per_5min": 200,
    "distinct_paths": 50,
    "sensitive_paths": 5,
    "risk_threshold": 70,
    "attack_threshold": 5,
    "request_rate_threshold": 30,
    "ban_duration_seconds": 3600,
}

# --- fixed values: risk score (weight, cap) -----------------------------------
RISK_WEIGHTS = {
    "attack_frequency": 0.3,
    "status_4xx_rate": 0.2,
    "unique_paths": 0.15,
    "user_agent_diversity": 0.1,
    "geo_risk": 0.1,
    "ban_history": 0.15,
}
GEO_RISK = {"low": 0, "medium": 10, "high": 25}

# --- fixed values: simulated geo table (lowest octet, highest octet, ...) ------
GEO_OCTETS = [
    (0, 49, "US", "New York", "Example ISP", "medium"),
    (50, 99, "CN", "Beijing", "China Telecom", "low"),
    (100, 149, "RU", "Moscow", "Russian ISP", "high"),
    (150, 255, "Unknown", "Unknown", "Unknown", "medium"),
]
GEO_PRIVATE_OCTETS = [10, 172, 192]
GEO_PRIVATE = ("Private", "Private Network", "Private", "low")
GEO_UNKNOWN = ("Unknown", "Unknown", "Unknown", "medium")

# --- fixed values: special-purpose address blocks ------------------------------
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "255.255.255.255/32",
]
PRIVATE_V4_EXCEPT = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = [
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
PRIVATE_V6_EXCEPT = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
]
MAPPED_V4_PREFIX = "00000000000000000000ffff"

DEFAULT_ALLOW_IPS = ["127.0.0.1", "::1"]
DEFAULT_ALLOW_NETWORKS = ["192.168.0.0/16", "10.0.0.0/8"]

# --- fixed values: security events --------------------------------------------
EVENT_TYPES = [
    "login_attempt", "login_success", "login_failure", "brute_force_attack",
    "sql_injection", "xss_attempt", "directory_traversal", "command_injection",
    "file_inclusion", "csrf_attempt", "dos_attack", "ddos_attack",
    "malware_detected", "suspicious_activity", "privilege_escalation",
    "data_exfiltration", "unauthorized_access", "configuration_change",
    "system_compromise", "policy_violation",
]
INDICATOR_EVENT_TYPE = [
    ("sql_injection", "sql_injection"),
    ("xss", "xss_attempt"),
    ("directory_traversal", "directory_traversal"),
    ("command_injection", "command_injection"),
]
THREAT_BASE_SCORES = {
    "sql_injection": 80, "command_injection": 90, "xss_attempt": 60,
    "directory_traversal": 70, "brute_force_attack": 50, "dos_attack": 60,
    "ddos_attack": 80, "malware_detected": 95, "system_compromise": 100,
    "data_exfiltration": 95, "privilege_escalation": 85,
}
THREAT_DEFAULT_SCORE = 30
LEVEL_SCORES = {"info": 0, "low": 10, "medium": 20, "high": 30, "critical": 40}
PCI_EVENT_TYPES = ["login_attempt", "login_success", "login_failure", "brute_force_attack"]
GDPR_EVENT_TYPES = ["data_exfiltration", "unauthorized_access"]

# --- fixed values: alert severities and default metric thresholds --------------
ATTACK_SEVERITY = {
    "sql_injection": "critical", "xss": "high", "brute_force": "high",
    "directory_traversal": "high", "command_injection": "critical",
    "file_inclusion": "high", "csrf": "medium", "dos": "high",
}
DEFAULT_THRESHOLDS = {
    "request_rate": 100.0, "error_rate": 0.1, "attack_frequency": 10.0,
    "response_time": 1000.0, "cpu_usage": 80.0, "memory_usage": 85.0,
    "disk_usage": 90.0,
}
PERF_THRESHOLDS = {
    "response_time_p95": 1000.0, "error_rate": 0.05, "cpu_usage": 80.0, "memory_usage": 85.0,
}
SEVERITIES = ["low", "medium", "high", "critical"]

# --- fixed values: system log keyword classes, first class wins ----------------
BAN_REASON_PATTERNS = [
    r"reason[=:]\s*[\"']?([^\"',|]+)[\"']?",
    r"ban_reason[=:]\s*[\"']?([^\"',|]+)[\"']?",
    r"因为[：:]?\s*([^，,|]+)",
    r"due to[：:]?\s*([^，,|]+)",
]
BAN_REASON_CLASSES = [
    ("SQL Injection", ["sql", "injection", "union", "select", "drop", "insert"]),
    ("XSS Attack", ["xss", "script", "javascript", "onload", "onerror"]),
    ("Path Traversal", ["../", "..\\", "path traversal", "directory traversal"]),
    ("Brute Force", ["brute", "force", "login", "password", "auth"]),
    ("Too Many 404s", ["404", "not found", "missing"]),
    ("DoS/DDoS", ["ddos", "dos", "flood", "rate limit"]),
    ("Malicious Bot", ["bot", "crawler", "spider", "scraper"]),
    ("Security Scanner", ["scan", "probe", "vulnerability"]),
    ("Malicious Upload", ["upload", "shell", "webshell", "backdoor"]),
    ("Malicious Activity", ["malicious", "suspicious", "attack", "exploit"]),
]
ATTACK_TYPE_CLASSES = [
    ("SQL Injection", ["sql", "injection", "union", "select", "drop", "insert", "update",
                       "delete", "exec", "sp_", "xp_", "information_schema"]),
    ("XSS", ["xss", "script", "javascript", "onload", "onerror", "onclick", "alert(",
             "document.", "window.", "<script", "</script>"]),
    ("Path Traversal", ["../", "..\\", "path traversal", "directory traversal", "/etc/passwd",
                        "/proc/", "c:\\windows", "..%2f", "%2e%2e"]),
    ("Brute Force", ["brute", "force", "login", "password", "auth", "credential", "dictionary",
                     "wordlist", "hydra", "medusa"]),
    ("DoS/DDoS", ["dos", "ddos", "flood", "rate limit", "slowloris", "syn flood", "udp flood",
                  "amplification"]),
    ("File Inclusion", ["file inclusion", "lfi", "rfi", "include", "require", "php://filter",
                        "data://", "expect://"]),
    ("Command Injection", ["command injection", "cmd", "exec", "system", "shell", "|", "&&",
                           "||", ";", "`", "$("]),
    ("Malicious Bot", ["bot", "crawler", "spider", "scraper", "scanner", "nikto", "nmap",
                       "sqlmap", "dirb", "gobuster"]),
    ("Malicious Upload", ["upload", "shell", "webshell", "backdoor", ".php", ".jsp", ".asp",
                          ".aspx", "eval(", "base64_decode"]),
    ("CSRF", ["csrf", "cross-site request", "forgery"]),
    ("Exploit", ["exploit", "vulnerability", "cve-", "metasploit", "payload", "shellcode",
                 "buffer overflow"]),
]
SEVERITY_CRITICAL_WORDS = ["sql injection", "command injection", "rce", "remote code", "shell",
                           "backdoor", "privilege escalation", "root access"]
SEVERITY_HIGH_WORDS = ["xss", "csrf", "file inclusion", "path traversal",
                       "authentication bypass", "unauthorized access"]
SEVERITY_MEDIUM_WORDS = ["brute force", "dos", "ddos", "scanner", "probe"]
SEVERITY_LOW_WORDS = ["404", "not found", "timeout", "connection"]
SYSTEM_EVENT_WORDS = [
    ("banned", "ip_banned"), ("unbanned", "ip_unbanned"), ("attack", "attack_detected"),
    ("system", "system_event"), ("performance", "performance_metric"),
]
LOG_LEVELS = ["CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG"]

# --- fixed values: field names that are never written out ----------------------
SENSITIVE_KEYS = [
    "password", "passwd", "pwd", "token", "access_token", "refresh_token", "secret",
    "api_secret", "client_secret", "key", "api_key", "private_key", "auth",
    "authorization", "credential", "session", "cookie", "csrf",
]

# --- fixed values: tenancy ------------------------------------------------------
PERMISSIONS = [
    "system:admin", "system:config", "system:monitor",
    "tenant:create", "tenant:update", "tenant:delete", "tenant:view",
    "user:create", "user:update", "user:delete", "user:view",
    "ip:ban", "ip:unban", "ip:view", "ip:whitelist",
    "rule:create", "rule:update", "rule:delete", "rule:view",
    "log:view", "log:export", "report:view", "report:export",
]
ROLE_PERMISSIONS = {
    "super_admin": PERMISSIONS,
    "tenant_admin": [
        "tenant:view", "tenant:update",
        "user:create", "user:update", "user:delete", "user:view",
        "ip:ban", "ip:unban", "ip:view", "ip:whitelist",
        "rule:create", "rule:update", "rule:delete", "rule:view",
        "log:view", "log:export", "report:view", "report:export",
    ],
    "security_admin": [
        "ip:ban", "ip:unban", "ip:view", "ip:whitelist",
        "rule:create", "rule:update", "rule:delete", "rule:view",
        "log:view", "log:export", "report:view", "report:export",
    ],
    "operator": ["ip:ban", "ip:unban", "ip:view", "rule:view", "log:view", "report:view"],
    "viewer": ["ip:view", "rule:view", "log:view", "report:view"],
}
DEFAULT_QUOTA = {
    "max_banned_ips": 1000, "max_rules": 100, "max_users": 10,
    "max_api_requests_per_hour": 10000, "max_log_retention_days": 30,
    "max_storage_mb": 1000, "max_concurrent_sessions": 10,
}
# quota resource -> (quota column, usage column that feeds it; None = never fed)
QUOTA_RESOURCES = [
    ("banned_ips", "max_banned_ips", "banned_ips"),
    ("rules", "max_rules", "rules"),
    ("users", "max_users", "users"),
    ("api_requests_per_hour", "max_api_requests_per_hour", None),
    ("storage_mb", "max_storage_mb", "storage_mb"),
    ("concurrent_sessions", "max_concurrent_sessions", "concurrent_sessions"),
]

# --- fixed values: notification routing -----------------------------------------
NOTIFICATION_ROUTES = {
    "info": ["email"],
    "warning": ["email", "dingtalk"],
    "error": ["email", "dingtalk", "wechat"],
    "ban": ["email", "dingtalk"],
    "unban": ["email"],
}

# --- fixed values: message texts --------------------------------------------------
BAN_TEXT = {
    "malicious": "已知恶意IP",
    "risk": "风险评分过高: %.1f",
    "attacks": "攻击次数过多: %d",
    "burst": "短时间内频繁攻击",
    "not_found": "404错误过多: %d",
    "rate": "请求频率过高: %.1f/min",
    "none": "未达到封禁条件",
}
DURATION_UNITS = {"second": "秒", "minute": "分钟", "hour": "小时", "day": "天"}
SEVERITY_MARK = {"low": "🟡", "medium": "🟠", "high": "🔴", "critical": "🚨"}
STATUS_MARK = {"success": "✅", "info": "ℹ️", "warning": "⚠️", "error": "❌", "critical": "🚨"}
SEVERITY_LOG_LEVEL = {"low": "INFO", "medium": "WARNING", "high": "ERROR", "critical": "CRITICAL"}
STATUS_LOG_LEVEL = {"success": "INFO", "info": "INFO", "warning": "WARNING", "error": "ERROR",
                    "critical": "CRITICAL"}
ALERT_TEXT = {
    "threshold_title": "%s阈值超限",
    "threshold_body": "%s当前值%s超过阈值%.2f",
    "anomaly_title": "IP行为异常检测",
    "anomaly_body": "IP %s 检测到异常行为，异常分数: %.3f",
    "attack_title": "%s攻击检测",
    "attack_body": "检测到来自IP %s的%s攻击",
    "cpu_title": "CPU使用率过高",
    "cpu_body": "系统CPU使用率达到%s%%",
    "memory_title": "内存使用率过高",
    "memory_body": "系统内存使用率达到%s%%",
}

# --- fixed values: feature words per attack type (order matters: leftmost first) ---
FEATURE_KEYWORDS = [
    ("sql_injection", [
        "union", "select", "insert", "delete", "update", "drop", "create", "alter", "exec",
        "execute", "sp_", "xp_", "waitfor", "delay", "benchmark", "sleep", "pg_sleep",
        "information_schema", "sysobjects"]),
    ("xss", [
        "script", "javascript", "vbscript", "onload", "onerror", "onclick", "onmouseover",
        "onfocus", "onblur", "alert", "confirm", "prompt", "document.cookie",
        "window.location", "eval", "fromcharcode"]),
    ("command_injection", [
        "cat", "ls", "pwd", "whoami", "id", "uname", "ps", "netstat", "ifconfig", "rm", "mv",
        "cp", "chmod", "chown", "kill", "killall", "wget", "curl", "nc", "telnet", "ssh",
        "ftp"]),
    ("directory_traversal", [
        "../", "..\\", "%2e%2e%2f", "%2e%2e%5c", "....///", "....\\\\", "/etc/passwd",
        "/etc/shadow", "/windows/system32", "boot.ini"]),
    ("file_inclusion", [
        "php://filter", "php://input", "data://", "file://", "ftp://", "http://", "https://",
        "expect://", "zip://", "phar://"]),
]

# --- fixed values: declared policies (documented defaults) --------------------------
POLICY = {
    "ban_seconds": 3600, "max_ban_seconds": 86400, "ban_factor": 2,
    "not_found_window": 300, "not_found_count": 20, "not_found_rate": 0.5,
    "server_error_window": 180, "server_error_count": 10,
    "brute_window": 300, "brute_count": 10, "brute_score": 95,
    "brute_paths": ["/admin", "/login", "/wp-admin"],
    "blocked_countries": ["CN", "RU", "KP"], "allowed_countries": ["US", "CA", "GB"],
    "country_score": 50,
    "weights": {"pattern_match": 0.4, "frequency": 0.3, "geolocation": 0.2, "user_agent": 0.1},
    "decay": 0.9, "score_threshold": 80,
    "retention_days": {"critical": 1095, "high": 730, "medium": 365, "low": 90},
    "default_retention_days": 365,
}
