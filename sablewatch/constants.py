"""Vocabularies, patterns and weights that results depend on.

Everything here is data, not logic. The operators turn it into Columns.
"""

# --- fixed values: severity scale -------------------------------------------
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_RANK = {name: rank for rank, name in enumerate(SEVERITIES)}

# --- fixed values: HTTP attack patterns (tag, severity, pattern) ------------
HTTP_PATTERNS = (
    ("log4shell", "critical", r"(?i)\$\{jndi:(ldap|rmi|dns|iiop)"),
    ("shellshock", "critical", r"(?s)\(\s*\)\s*\{.*;\s*\}\s*;"),
    ("path-traversal", "high", r"(?i)(\.\./|\.\.\\|%2e%2e[/\\%])"),
    (
        "sql-injection",
        "high",
        r"(?i)(\bunion\b[\s/*]+\bselect\b|'\s*or\s*'?1'?\s*=\s*'?1|\bsleep\s*\(\d|"
        r"\bbenchmark\s*\(|information_schema)",
    ),
    (
        "command-injection",
        "high",
        r"(?i)(;|\||`|\$\()\s*(cat|wget|curl|nc|bash|sh|python|perl)\b",
    ),
    ("webshell-upload", "critical", r"(?i)\.(php|jsp|asp|aspx|phtml)[\d]?($|\?|;)"),
    ("xss-probe", "medium", r"(?i)(<script|javascript:|onerror\s*=)"),
    ("env-file-probe", "high", r"(?i)/\.(env|git|aws|ssh|svn)(/|$)"),
    ("cgi-probe", "medium", r"(?i)/cgi-bin/"),
    (
        "admin-probe",
        "low",
        r"(?i)/(wp-admin|wp-login|phpmyadmin|admin|manager/html|solr|actuator)",
    ),
)
USUAL_HTTP_METHODS = ("GET", "POST", "HEAD", "PUT", "OPTIONS", "DELETE", "PATCH")
LOGIN_FORM_FIELDS = (
    "username", "user", "usr", "login", "email", "log", "pwd", "password", "pass",
)

# --- fixed values: shell commands -------------------------------------------
FETCH_TOOLS = ("wget", "curl", "tftp")
SHELL_CRITICAL = ("wget", "curl", "tftp", "busybox", "chmod +x")
SHELL_HIGH = ("/etc/shadow", "passwd", "authorized_keys")
COMMAND_WRAPPERS = ("sudo", "nohup", "time", "env")

# --- fixed values: device default logins ------------------------------------
DEFAULT_LOGINS = (
    ("root", "xc3511"), ("root", "vizxv"), ("root", "admin"), ("admin", "admin"),
    ("root", "888888"), ("root", "xmhdipc"), ("root", "default"), ("root", "juantech"),
    ("root", "123456"), ("root", "54321"), ("support", "support"), ("root", ""),
    ("admin", "password"), ("root", "root"), ("user", "user"), ("admin", "1234"),
    ("root", "12345"), ("guest", "guest"), ("admin", ""), ("root", "pass"),
)

# --- fixed values: Redis verbs ----------------------------------------------
REDIS_VERB_TAGS = {
    "config": "redis-config-abuse",
    "slaveof": "redis-replication-hijack",
    "replicaof": "redis-replication-hijack",
    "module": "redis-module-load",
    "eval": "redis-lua-eval",
    "evalsha": "redis-lua-eval",
    "save": "redis-persist",
    "bgsave": "redis-persist",
    "debug": "redis-debug",
    "migrate": "redis-migrate",
    "restore": "redis-restore",
}
REDIS_CRITICAL_VERBS = ("config", "module", "eval", "slaveof", "replicaof")
REDIS_PAYLOAD_MARKS = ("ssh-rsa", "ssh-ed25519", "* * * * *", "/etc/cron")

# --- fixed values: Docker API -----------------------------------------------
DOCKER_ROUTES = (
    ("containers-create", r"(?i)^/(v[\d.]+/)?containers/create"),
    ("containers-start", r"(?i)^/(v[\d.]+/)?containers/[^/]+/start"),
    ("containers-exec", r"(?i)^/(v[\d.]+/)?containers/[^/]+/exec"),
    ("exec-start", r"(?i)^/(v[\d.]+/)?exec/[^/]+/start"),
    ("containers-list", r"(?i)^/(v[\d.]+/)?containers/json"),
    ("images-create", r"(?i)^/(v[\d.]+/)?images/create"),
    ("images-list", r"(?i)^/(v[\d.]+/)?images/json"),
    ("version", r"(?i)^/(v[\d.]+/)?version"),
    ("info", r"(?i)^/(v[\d.]+/)?info"),
    ("ping", r"(?i)^/(v[\d.]+/)?_ping"),
)
DOCKER_RECON_ROUTES = ("ping", "version", "info", "containers-list", "images-list")
DOCKER_EXEC_ROUTES = ("containers-start", "containers-exec", "exec-start")
DOCKER_HOST_BIND = (
    r"""(?i)(^|["'\s])(/|/etc|/root|/home|/var/run/docker\.sock|/proc|/sys)(:|/[^:]*:)"""
)
DOCKER_MINER_IMAGE = r"(?i)(xmrig|monero|miner|kinsing|cryptonight|watchbog|kaiten)"

# --- fixed values: FTP verbs (verb, event type, severity, tag) --------------
FTP_VERBS = (
    ("PASS", "auth_attempt", "medium", "ftp-password"),
    ("CWD", "command", "low", "ftp-navigate"),
    ("PASV", "command", "low", "ftp-passive"),
    ("PORT", "command", "high", "ftp-bounce-attempt"),
    ("LIST", "command", "low", "ftp-list"),
    ("NLST", "command", "low", "ftp-list"),
    ("STOR", "file_upload", "critical", "ftp-upload-attempt"),
    ("STOU", "file_upload", "critical", "ftp-upload-attempt"),
    ("APPE", "file_upload", "critical", "ftp-upload-attempt"),
    ("RETR", "command", "medium", "ftp-download-attempt"),
    ("DELE", "command", "high", "ftp-modify-attempt"),
    ("RMD", "command", "high", "ftp-modify-attempt"),
    ("MKD", "command", "high", "ftp-modify-attempt"),
    ("RNFR", "command", "high", "ftp-modify-attempt"),
    ("RNTO", "command", "high", "ftp-modify-attempt"),
    ("SITE", "command", "high", "ftp-modify-attempt"),
)
FTP_SILENT_VERBS = ("SYST", "FEAT", "PWD", "XPWD", "TYPE", "QUIT", "NOOP")
FTP_ANONYMOUS = ("anonymous", "ftp")

# --- fixed values: SSH client banners ---------------------------------------
SSH_BANNER_NEEDLES = (
    "libssh", "go", "paramiko", "putty", "zgrab", "masscan", "nmap", "jsch",
    "ssh-2.0-ruby", "russh",
)

# --- fixed values: user agents ----------------------------------------------
MALWARE_AGENTS = (
    ("hello, world", "malware:mirai-variant"),
    ("xmrig", "malware:cryptominer"),
    ("mozi", "malware:mozi"),
    ("hakai", "malware:hakai"),
    ("botnet", "malware:generic-botnet"),
)
SCANNER_AGENTS = (
    ("zgrab", "scanner:zgrab"),
    ("masscan", "scanner:masscan"),
    ("nmap", "scanner:nmap"),
    ("nikto", "scanner:nikto"),
    ("sqlmap", "scanner:sqlmap"),
    ("dirbuster", "scanner:dirbuster"),
    ("gobuster", "scanner:gobuster"),
    ("wpscan", "scanner:wpscan"),
    ("nuclei", "scanner:nuclei"),
    ("curl/", "tool:curl"),
    ("wget/", "tool:wget"),
    ("python-requests", "tool:python-requests"),
    ("go-http-client", "tool:go-http"),
    ("libwww-perl", "tool:libwww"),
    ("censys", "research:censys"),
    ("shodan", "research:shodan"),
    ("internetmeasurement", "research:internet-measurement"),
    ("paloaltonetworks", "research:paloalto"),
)
GENERIC_USERNAMES = (
    "root", "admin", "administrator", "user", "test", "guest", "oracle", "ubuntu",
    "postgres", "mysql", "ftp", "www", "web", "support", "pi", "default", "operator",
    "service", "backup", "deploy", "git", "jenkins",
)
SCORE_EXACT_IP = 40.0
SCORE_CIDR = 25.0
SCORE_SCANNER_AGENT = 15.0
SCORE_MALWARE_AGENT = 30.0
SCORE_SHORT_AGENT = 5.0
SCORE_GENERIC_USERNAME = 2.0

# --- fixed values: network operators ----------------------------------------
OPERATOR_WORDS = (
    (
        "hosting-provider",
        (
            "amazon", "aws", "google", "microsoft", "azure", "digitalocean", "linode",
            "vultr", "ovh", "hetzner", "scaleway", "contabo", "leaseweb", "choopa",
            "m247", "cloudflare", "alibaba", "tencent", "oracle cloud", "hostinger",
            "godaddy", "namecheap", "colocrossing", "quadranet", "psychz", "datacamp",
        ),
    ),
    (
        "vpn-or-tor",
        (
            "nordvpn", "expressvpn", "privateinternetaccess", "mullvad", "surfshark",
            "protonvpn", "cyberghost", "tor exit", "torservers", "relay",
        ),
    ),
    ("consumer-isp", ("telecom", "broadband", "cable", "dsl", "mobile", "wireless")),
    ("academic", ("university", "education", "academ")),
)

# --- fixed values: source score ---------------------------------------------
SCORE_CEILINGS = {
    "volume": 15.0,
    "persistence": 12.0,
    "credential_breadth": 18.0,
    "service_breadth": 8.0,
    "severity": 25.0,
    "post_exploitation": 30.0,
    "threat_intel": 20.0,
}
SCORE_MAX = 100.0
EXPLOIT_TAGS = (
    "log4shell", "shellshock", "sql-injection", "path-traversal", "command-injection",
    "webshell-upload", "env-file-probe",
)
CARRIED_TAG_PREFIXES = ("scanner:", "research:", "malware:", "tool:", "ti:")

# --- fixed values: payload formats ------------------------------------------
FILE_MAGICS = (
    ("7F454C46", "elf", "application/x-executable"),
    ("4D5A", "pe", "application/vnd.microsoft.portable-executable"),
    ("CAFEBABE", "macho-fat-or-class", "application/x-mach-binary"),
    ("CFFAEDFE", "macho", "application/x-mach-binary"),
    ("504B0304", "zip", "application/zip"),
    ("1F8B", "gzip", "application/gzip"),
    ("425A68", "bzip2", "application/x-bzip2"),
    ("FD377A585A", "xz", "application/x-xz"),
    ("526172211A07", "rar", "application/vnd.rar"),
    ("377ABCAF271C", "7z", "application/x-7z-compressed"),
    ("89504E47", "png", "image/png"),
    ("25504446", "pdf", "application/pdf"),
)
SCRIPT_INTERPRETERS = ("sh", "bash", "python", "perl", "ruby", "node", "php")
ELF_MACHINES = {
    0x02: "sparc", 0x03: "x86", 0x04: "m68k", 0x08: "mips", 0x14: "powerpc",
    0x15: "powerpc64", 0x16: "s390", 0x28: "arm", 0x2A: "superh", 0x32: "ia64",
    0x3E: "x86-64", 0x5C: "arc", 0xB7: "aarch64", 0xF3: "riscv",
}
ELF_TYPES = {1: "relocatable", 2: "executable", 3: "shared-object", 4: "core"}
ELF_OSABIS = {0: "sysv", 3: "linux", 9: "freebsd"}
PE_MACHINES = {
    0x014C: "x86", 0x0166: "mips", 0x01C0: "arm", 0x01C4: "armnt", 0x0200: "ia64",
    0x8664: "x86-64", 0xAA64: "aarch64",
}
BEHAVIOUR_NEEDLES = (
    ("busybox", "iot:busybox"),
    ("/bin/busybox", "iot:busybox"),
    ("wget", "downloader:wget"),
    ("curl -", "downloader:curl"),
    ("tftp", "downloader:tftp"),
    ("chmod +x", "dropper:chmod"),
    ("chmod 777", "dropper:chmod"),
    ("/tmp/", "dropper:tmp-staging"),
    ("/dev/watchdog", "iot:watchdog-disable"),
    ("crontab", "persistence:cron"),
    ("/etc/rc.local", "persistence:rc-local"),
    ("authorized_keys", "persistence:ssh-key"),
    ("iptables", "defense-evasion:firewall"),
    ("/proc/self/exe", "anti-analysis:self-inspect"),
    ("ptrace", "anti-analysis:ptrace"),
    ("upx!", "packer:upx"),
    ("mirai", "family-string:mirai"),
    ("gafgyt", "family-string:gafgyt"),
    ("tsunami", "family-string:tsunami"),
    ("xmrig", "miner:xmrig"),
    ("stratum+tcp", "miner:stratum"),
    ("nc -e", "backdoor:netcat"),
    ("/dev/tcp/", "backdoor:bash-tcp"),
)
MIN_STRING_CHARS = 6
PACKED_ENTROPY = 7.2
PACKABLE_TYPES = ("elf", "pe", "unknown")

# --- fixed values: indicator patterns ---------------------------------------
IOC_URL = r"""(?i)https?://[^\s"'<>\\)\x00]{4,}"""
# Word edges are spelled out: bytes above 0x7F are no word characters here.
IOC_IPV4 = r"(?<![A-Za-z0-9_])(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9_])"
IOC_DOMAIN = (
    r"(?i)(?<![A-Za-z0-9_])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+"
    r"(?:com|net|org|ru|cn|info|biz|top|xyz|io|cc|su|tk|pw|onion)(?![A-Za-z0-9_])"
)
SECOND_STAGE_URL = r"""(?:https?|ftp|tftp)://[^\s;'"|&)]+"""

# --- fixed values: campaign facets ------------------------------------------
FACET_WEIGHTS = {
    "payloads": 3.0,
    "credentials": 2.5,
    "paths": 1.5,
    "usernames": 1.0,
    "tags": 1.0,
    "services": 0.25,
}
DISCRIMINATIVE_FACETS = ("credentials", "paths", "payloads", "usernames")
CAMPAIGN_THRESHOLD = 0.35
CAMPAIGN_MIN_SIZE = 2

# --- fixed values: ATT&CK techniques (id, name, tactic) ---------------------
TECHNIQUES = (
    ("T1595.003", "Active Scanning: Wordlist Scanning", "Reconnaissance"),
    ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    ("T1078", "Valid Accounts", "Initial Access"),
    ("T1078.001", "Default Accounts", "Initial Access"),
    ("T1110.001", "Brute Force: Password Guessing", "Credential Access"),
    ("T1110.003", "Brute Force: Password Spraying", "Credential Access"),
    ("T1110.004", "Brute Force: Credential Stuffing", "Credential Access"),
    ("T1003.008", "OS Credential Dumping: /etc/passwd and /etc/shadow", "Credential Access"),
    ("T1552.001", "Unsecured Credentials: Credentials In Files", "Credential Access"),
    ("T1059", "Command and Scripting Interpreter", "Execution"),
    ("T1059.004", "Command and Scripting Interpreter: Unix Shell", "Execution"),
    ("T1610", "Deploy Container", "Execution"),
    ("T1611", "Escape to Host", "Privilege Escalation"),
    ("T1053.003", "Scheduled Task/Job: Cron", "Persistence"),
    ("T1505.003", "Server Software Component: Web Shell", "Persistence"),
    ("T1046", "Network Service Discovery", "Discovery"),
    ("T1083", "File and Directory Discovery", "Discovery"),
    ("T1105", "Ingress Tool Transfer", "Command and Control"),
    ("T1090", "Proxy", "Command and Control"),
    ("T1499", "Endpoint Denial of Service", "Impact"),
    ("T1496", "Resource Hijacking", "Impact"),
)
TACTICS = (
    "Reconnaissance", "Initial Access", "Execution", "Persistence",
    "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery",
    "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
)
UNMAPPED_TACTIC = "Unmapped"

# --- fixed values: Cowrie event ids (id, event type, severity) --------------
COWRIE_EVENTS = (
    ("cowrie.session.connect", "connect", "info"),
    ("cowrie.login.failed", "auth_attempt", "medium"),
    ("cowrie.login.success", "auth_success", "high"),
    ("cowrie.command.input", "command", "high"),
    ("cowrie.command.failed", "command", "medium"),
    ("cowrie.session.file_download", "file_upload", "critical"),
    ("cowrie.session.file_upload", "file_upload", "critical"),
    ("cowrie.session.closed", "disconnect", "info"),
    ("cowrie.client.version", "connect", "low"),
    ("cowrie.direct-tcpip.request", "connect", "high"),
)

# --- fixed values: time-series buckets in seconds ---------------------------
BUCKET_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}
MAX_SERIES_POINTS = 5000
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# --- fixed values: replay pacing in milliseconds ----------------------------
REPLAY_MIN_STEP_MS = 140
REPLAY_MAX_STEP_MS = 2200
REPLAY_IDLE_MS = 5000

# --- fixed values: export columns -------------------------------------------
EVENT_CSV_COLUMNS = (
    "event_id", "ts", "sensor", "service", "event_type", "severity", "src_ip", "src_port",
    "dst_port", "username", "password", "command", "http_method", "path", "user_agent",
    "status_code", "country", "country_name", "city", "asn", "as_org", "threat_score",
    "session_id",
)
ALERT_CSV_COLUMNS = (
    "alert_id", "rule_id", "rule_name", "severity", "src_ip", "service", "title",
    "hit_count", "status", "first_seen", "last_seen",
)
