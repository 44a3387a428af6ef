"""Patterns, word lists and limits that decide results.

Patterns are written for Java's regex engine so that they match what an RE2
engine would: ``(?d)`` limits line ends to ``\\n``, ``(?u)`` folds case over
Unicode, and blanks are spelled out because Java's ``\\s`` also has VT.
"""

BLANK = r"[\t\n\f\r ]"
NON_BLANK = r"[^\t\n\f\r ]"

# Redaction patterns, applied in this order.
REDACT = (
    rf"(?iu)(password|passwd|secret|token|key){BLANK}*={BLANK}*{NON_BLANK}+",
    r"AKIA[0-9A-Z]{16}",
    rf"(?iu)bearer{BLANK}+[A-Za-z0-9\-._~+/]+=*",
)
REDACTED = "[REDACTED]"

# Commands that carry no information.
TRIVIAL = ("cd", "clear", "cls", "history", "ls", "ll", "pwd", "exit", "logout")

# Commands that only wrap another command.
WRAPPERS = ("sudo", "time", "nohup", "strace", "nice", "timeout", "env")

# Commands that show file content unchanged.
PASSTHROUGH = ("cat", "less", "more", "head", "tail", "bat", "strings")

# Terminal control sequences.
ANSI = (
    r"\x1b\[[0-9;]*[a-zA-Z]|\x1b\][^\x07]*(?:\x07|\x1b\\)"
    r"|\x1b[()][AB012]|\x1b[=>NH]"
)

# Content signatures, first match wins.
SIGNATURE_SAMPLE_BYTES = 2048
SIGNATURES = (
    (rf"(?dm)(Nmap scan report for|^\d+/(tcp|udp){BLANK}+open{BLANK})", "nmap"),
    (r"(?diu)(═{3,}|╔|╗|╚|╝).*(linpeas|Linux Privilege)", "linpeas"),
)

# Line patterns of the tool extractors.
NMAP_PORT = r"\d+/(?:tcp|udp)"
NMAP_OPEN = "open"
NMAP_STARTS = (
    "Nmap scan report for",
    "Host is up",
    "OS details:",
    "Running:",
    "Aggressive OS guesses:",
    "|",
    "Service Info:",
)
STATUS_CODES = ("200", "301", "302", "403")
STATUS_LABEL = "Status:"
NIKTO_LINE = "+"
LINPEAS_HEADER = r"[═╔╗╚╝]{3,}"
LINPEAS_FINDING = (
    r"99%|95%|CVE-|SGID|SUID|writable|Vulnerable|root|password"
    r"|credential|\.ssh|id_rsa|shadow|sudoers"
)
GIT_DIFF = "diff --git"
GIT_LINE = ("diff --git", "---", "+++", "@@")

# Text that replaces an extraction without results.
NO_PORTS = "[no open ports or services found]"
NO_STATUS = "[no results with status 200/301/302/403]"
NO_FINDINGS = "[no findings]"
NO_SECTIONS = "[no significant findings detected]"
NO_PROCESSES = "[no user-space processes]"
NO_DIFF = "[no diff output]"

# Byte budgets per tool.
DEFAULT_LIMIT = 4096
LIMITS = {
    "nmap": 2048,
    "gobuster": 1536,
    "linpeas": 4096,
    "cat": 4096,
    "curl": 2048,
    "git": 3072,
    "find": 2048,
    "grep": 2048,
}

# Recording limits.
MAX_EVENTS_PER_TERMINAL = 10_000
MAX_SESSION_SECONDS = 8 * 3600
MAX_OUTPUT_BYTES = 256 * 1024
MAX_LINE_BYTES = 1024 * 1024

# Tool weights for session detection.
PENTEST_TOOLS = {
    "nmap": "0.30", "gobuster": "0.30", "feroxbuster": "0.30", "sqlmap": "0.40",
    "hydra": "0.30", "john": "0.30", "hashcat": "0.30", "msfconsole": "0.50",
    "msfvenom": "0.40", "nikto": "0.30", "dirb": "0.30", "wfuzz": "0.30",
    "ffuf": "0.30", "linpeas": "0.40", "winpeas": "0.40", "pspy": "0.30",
    "chisel": "0.30", "ligolo": "0.30", "crackmapexec": "0.40",
    "enum4linux": "0.30", "smbclient": "0.20", "evil-winrm": "0.40",
    "bloodhound": "0.40", "responder": "0.30", "nc": "0.10", "netcat": "0.10",
    "socat": "0.10", "searchsploit": "0.30", "burpsuite": "0.30", "zap": "0.30",
}
DEV_TOOLS = {
    "go": "0.20", "python": "0.10", "python3": "0.10", "node": "0.10",
    "npm": "0.20", "cargo": "0.30", "rustc": "0.30", "gcc": "0.20",
    "make": "0.15", "docker": "0.10", "kubectl": "0.20",
    "docker-compose": "0.15", "pytest": "0.30", "jest": "0.30", "mocha": "0.30",
    "pip": "0.15", "pip3": "0.15", "yarn": "0.20", "mvn": "0.20",
    "gradle": "0.20", "terraform": "0.20", "ansible": "0.20", "code": "0.10",
    "mvim": "0.05",
}

# Command patterns for session detection, in signal order
# (key, pattern, session type, weight, reason).
COMMAND_SIGNALS = (
    (
        "ctf_ip",
        r"10\.(10|129)\.\d{1,3}\.\d{1,3}",
        "pentest",
        "0.40",
        "HTB/CTF IP range detected (10.10.x.x / 10.129.x.x)",
    ),
    (
        "reverse_shell",
        rf"(?diu)(bash{BLANK}+-i{BLANK}+>&{BLANK}*/dev/tcp|nc{BLANK}+.*-e{BLANK}"
        rf"|python[3]?{BLANK}+-c{BLANK}+.*socket|socat{BLANK}+.*exec)",
        "pentest",
        "0.50",
        "reverse shell pattern detected",
    ),
    (
        "go_commands",
        rf"go{BLANK}+(build|test|run|vet|mod)",
        "debug",
        "0.25",
        "Go build/test commands",
    ),
    (
        "npm_commands",
        rf"npm{BLANK}+(test|run|start|install)",
        "debug",
        "0.20",
        "npm commands",
    ),
    (
        "git_workflow",
        rf"git{BLANK}+(commit|push|pull|merge|rebase)",
        "debug",
        "0.15",
        "Git workflow commands",
    ),
    (
        "test_runners",
        rf"pytest|go{BLANK}+test|npm{BLANK}+test|jest",
        "debug",
        "0.25",
        "Test runner commands",
    ),
    (
        "docker_commands",
        rf"docker{BLANK}+(build|run|compose)",
        "debug",
        "0.15",
        "Docker commands",
    ),
)
PENTEST_REASON = "pentest tool: "
DEV_REASON = "dev tool: "
NO_SIGNAL_REASON = "no strong signals detected"
MIN_CONFIDENCE = 0.3

# Transcript markers.
MARKER_START = "\x1b]7770;"
MARKER_END = "\x07"
