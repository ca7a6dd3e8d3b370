"""Values that results depend on: word lists, patterns, labels. All patterns are Java regular expressions."""

# Names of log families, in the order in which they are tested.
FAMILIES = (
    "json", "cef", "leef", "ncsa", "rfc5424", "rfc3164", "cri", "nginx_error", "python", "java", "postgres", "pipe", "csv", "semicolon", "tab", "logfmt",
)
# Severity words that may open a line or a field.
SEVERITY_WORDS = (
    "CRITICAL", "WARNING", "EMERGENCY", "SEVERE", "NOTICE", "TRACE", "DEBUG", "ERROR", "FATAL", "EMERG", "ALERT", "CRIT", "INFO", "WARN", "ERR",
)
# Keys that name a canonical column.
ALIASES = {
    "timestamp": ("timestamp", "@timestamp", "ts", "time", "datetime", "date", "t", "eventtime", "devtime", "time_local", "log_time", "logged_at"),
    "severity": ("severity", "level", "lvl", "loglevel", "log_level", "levelname", "log.level", "priority", "syslog_severity", "status_code_severity", "s"),
    "message": ("message", "msg", "log", "text", "body", "payload", "raw_log", "description", "details", "reason"),
    "source": ("source", "host", "hostname", "service", "app", "application", "logger", "logger_name", "name", "component", "program", "caller", "c", "device_vendor"),
    "event_type": ("event_type", "event", "type", "action", "operation", "category", "method", "command", "event_class_id", "msg_id"),
}
# Words of each canonical severity; numbers are syslog levels.
SEVERITIES = {
    "debug": ("trace", "debug", "dbg", "d"),
    "info": ("info", "inform", "information", "informational", "notice", "note", "system", "successful", "ok", "i"),
    "warning": ("warning", "warn", "w"),
    "error": ("error", "err", "exception", "fail", "failure", "bad", "e"),
    "critical": ("critical", "crit", "fatal", "severe", "emerg", "emergency", "alert", "panic", "f"),
}
SYSLOG_LEVELS = ("critical", "critical", "critical", "error", "warning", "info", "info", "debug")
# Keys that may stand in for a missing source, in order.
SOURCE_FALLBACKS = ("program", "logger", "app_name", "host", "hostname", "device_vendor", "client", "ip")
# Words after "user" or "for" that are no user names.
NOT_USERS = ("invalid", "authentication", "to", "the", "a", "an")
# Events told from the message, first match wins; (pattern, case matters, name).
EVENTS = (
    (r"\b(?:failed\s+password|authentication\s+fail(?:ed|ure)|invalid\s+credentials|unauthorized|permission\s+denied|access\s+denied)\b", False, "auth_failure"),
    (r"\b(?:accepted\s+password|session\s+opened|login\s+successful|authentication\s+succeeded)\b", False, "auth_success"),
    (r"\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b|statement:\s+|duration:\s+\d+\.\d+\s+ms", True, "db_query"),
    (r"\b(?:connection\s+(?:refused|reset|timeout|failed|closed)|failed\s+to\s+connect|network\s+unreachable)\b", False, "connection_error"),
    (r"\b(?:started|shutting\s+down|shutdown|ready\s+for\s+connections|ready\s+to\s+accept|listening\s+on|server\s+startup)\b", False, "service_lifecycle"),
    (r"\b(?:exception|traceback|fatal\s+error|panic:)\b", False, "exception"),
)
# What masking replaces, in order.
MASKS = (
    (r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+\-]\d{2}:?\d{2})?", "TS"),
    (r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "TS"),
    (r"\d{2}/[A-Za-z]{3}/\d{4}(?::\d{2}:\d{2}:\d{2})?", "TS"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "UUID"),
    (r"\b[0-9a-fA-F]{16,}\b", "HEX"),
    (r"\b\d+\.\d+\b", "NUM"),
    (r"\b\d+\b", "NUM"),
)
# Shapes that tell a family.
_DATETIME_MS = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[,.]\d{3}"
SHAPES = {
    "ncsa": r'\[[^\]]+\]\s+"[A-Z]+\s+[^"]+"\s+\d{3}',
    "rfc5424": r"^<\d{1,3}>\d+\s+",
    "rfc3164": r"^(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+[a-zA-Z0-9_.-]+\s+[a-zA-Z0-9_./-]+(?:\[\d+\])?:\s*",
    "rfc3164_loose": r"^(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+",
    "cri": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})\s+(?:stdout|stderr)\s+[FP]\s+",
    "cri_loose": r"^\d{4}-\d{2}-\d{2}T.*\s+(?:stdout|stderr)\s+[FP]\s+",
    "nginx_error": r"^\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[[a-z]+\]\s+\d+#\d+:",
    "python": r"^([A-Z]{3,8}):[a-zA-Z0-9_.]+:",
    "java_time": rf"^{_DATETIME_MS}",
    "java_main": r"\[main\]\s+(?:[A-Z]{3,8}\s+)?[a-zA-Z0-9_.$]+",
    "java_dashes": rf"^{_DATETIME_MS}\s+\d+\s+---\s+\[",
    "java_level": rf"^{_DATETIME_MS}\s+(?:\[[^\]]+\]\s+)?[A-Z]{{3,8}}\s+",
    "java_label": rf"^{_DATETIME_MS}\s+(?:\d+\s+---\s+\[|[A-Z]{{3,8}}\s+\[|[\[\(][^\]\)]+[\]\)]\s+[A-Z]{{3,8}})|\[main\]\s+(?:[A-Z]{{3,8}}\s+)?[a-zA-Z0-9_.$]+",
    "postgres": r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+[A-Z]{3,4})?\s+\[\d+\]\s+(?:[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+\s+)?[A-Z]{3,8}:\s+",
    "pair": r"""[a-zA-Z0-9_.-]+=(?:"[^"]*"|'[^']*'|[^ \t\n\r,;\]\}>\\)&]+)""",
    "exception": r"^[A-Za-z_][\w.]*(Error|Exception|Exit|Interrupt|Warning)\b",
}
# Labels of formats, in the order in which they are tried; (label, shape).
FORMAT_LABELS = (
    ("CEF (Common Event Format)", "^CEF:"),
    ("LEEF (Log Event Extended Format)", "^LEEF:"),
    ("NCSA Combined / Web Access Log", SHAPES["ncsa"]),
    ("RFC 5424 Syslog", SHAPES["rfc5424"]),
    ("RFC 3164 Syslog (BSD)", SHAPES["rfc3164"]),
    ("Kubernetes / CRI Container Log", SHAPES["cri"]),
    ("Nginx / Web Server Error Log", SHAPES["nginx_error"]),
    ("Python Standard Logger", SHAPES["python"]),
    ("Java Application / Log4j / Spring Boot", SHAPES["java_label"]),
)
LOGFMT_LABEL = "Logfmt / Key-Value Stream"
# Timestamps that may open a free-form line, in order.
OPENING_TIMES = (
    r"^\[?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?\]?",
    r"^\[?\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\]?",
    r"^\[?\d{2,4}/\d{2}/\d{2,4}\s+\d{2}:\d{2}:\d{2}\]?",
    r"^\[?[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\]?",
    r"^\[?\d{4}-\d{2}-\d{2}\b\]?",
    r"^\[?\d{10,13}\b\]?",
)
DATE_HINT = r"(?i)(\d{4}-\d{2}-\d{2}|\d{2,4}/\d{2}/\d{2,4}|[A-Z][a-z]{2}\s+\d{1,2})"
# Layouts with capturing groups, one per parser.
_ISO_ZONE = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})"
LAYOUTS = {
    "ncsa": r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([\w:/]+\s+[+\-]\d{4})\]\s+"([^"]+)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?',
    "cef": r"^CEF:\s*(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$",
    "leef": r"^LEEF:\s*(\d+(?:\.\d+)?)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$",
    "rfc5424": r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.*))?$",
    "cri": rf"^({_ISO_ZONE})\s+(stdout|stderr)\s+([FP])\s+(.*)$",
    "nginx_error": r"^(\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[([a-z]+)\]\s+(\d+#\d+):\s+(?:\*(\d+)\s+)?(.*)$",
    "spring": rf"^({_DATETIME_MS})\s+([A-Z]{{3,8}})\s+(\d+)\s+---\s+\[([^\]]+)\]\s+([a-zA-Z0-9_.$]+)\s*:\s*(.*)$",
    "java": rf"^({_DATETIME_MS})\s+(?:\[([^\]]+)\]\s+)?([A-Z]{{3,8}})\s+(?:\[([a-zA-Z0-9_.$]+)\]|\(([a-zA-Z0-9_.$]+)\)|([a-zA-Z0-9_.$]+))\s*(?:\(([a-zA-Z0-9_.$]+)\)\s*|\[([a-zA-Z0-9_.$]+)\]\s*)?(?:[-:]\s+)?(.*)$",
    "python_colon": r"^([A-Z]{3,8}):([a-zA-Z0-9_.]+):(.*)$",
    "python_dash": rf"^({_DATETIME_MS})\s*-\s*([a-zA-Z0-9_.]+)\s*-\s*([A-Z]{{3,8}})\s*-\s*(.*)$",
    "python_caller": rf"^\[({_DATETIME_MS})\]\s*\{{([^}}]+)\}}\s*([A-Z]{{3,8}})\s*-\s*(.*)$",
    "postgres": r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+[A-Z]{3,4})?)\s+\[(\d+)\]\s+(?:([a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+)\s+)?([A-Z]{3,8}):\s+(.*)$",
    "syslog_head": r"^([a-zA-Z0-9_-]+)\s+([a-zA-Z0-9_.-]+)(?:\[(\d+)\])?:\s*",
}
EXTENSION_PAIR = r"(\w+)=([^=]*)(?:\s+|$)"  # escaped equals signs are taken out before
LOGFMT_PAIR = r"""([a-zA-Z0-9_.-]+)=(?:"([^"]*)"|'([^']*)'|([^ \t\n\r,;\]\}>\\)&]+))"""
FREE_PAIR = r"""([a-zA-Z0-9_-]+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^ \t\n\r,;\]\}>\\)&]+)"""
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER = r"(?i)(?:for\s+(?:invalid\s+user\s+)?|user[\s=:]+)([a-zA-Z0-9_.-]+)"
PORT = r"(?i)\bport\s*[:=]?\s*(\d{2,5})\b"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
