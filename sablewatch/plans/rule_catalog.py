"""Detection rules: definitions, loading and validation (driver-side, tiny)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from sablewatch.constants import SEVERITY_RANK

RULE_TYPES = ("threshold", "distinct", "match", "ratio")


class RuleError(ValueError):
    """A rule definition that must not load."""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    type: str
    description: str = ""
    enabled: bool = True
    window_minutes: float = 60
    group_by: str = "src_ip"
    threshold: float = 1
    distinct_field: str | None = None
    where: dict[str, Any] = field(default_factory=dict)
    numerator_where: dict[str, Any] = field(default_factory=dict)
    mitre: tuple[str, ...] = ()

    @property
    def window_us(self) -> int:
        return int(self.window_minutes * 60_000_000)


_FIELDS = {f.name for f in fields(Rule)}


def rules_from_records(records: Any) -> list[Rule]:
    """Build and validate rules; the first bad one stops the load."""
    if not isinstance(records, list):
        raise RuleError("rules must be a list")
    out: list[Rule] = []
    for record in records:
        if not isinstance(record, dict) or "id" not in record:
            raise RuleError("a rule has no 'id'")
        rid = record["id"]
        extra = sorted(set(record) - _FIELDS)
        if extra:
            raise RuleError(f"rule {rid}: unknown key(s) {extra}")
        if any(rid == rule.id for rule in out):
            raise RuleError(f"duplicate rule id {rid!r}")
        given = dict(record, mitre=tuple(record.get("mitre") or ()))
        given["description"] = (given.get("description") or "").strip()
        try:
            rule = Rule(**given)
        except TypeError as exc:
            raise RuleError(f"rule {rid}: {exc}") from exc
        out.append(_checked(rule))
    return out


def _checked(rule: Rule) -> Rule:
    problems = (
        (rule.type not in RULE_TYPES, f"type {rule.type!r} is not one of {RULE_TYPES}"),
        (rule.severity not in SEVERITY_RANK, f"severity {rule.severity!r} is not known"),
        (rule.type == "distinct" and not rule.distinct_field, "distinct needs distinct_field"),
        (rule.type == "ratio" and not rule.numerator_where, "ratio needs numerator_where"),
        (rule.window_minutes <= 0, "window_minutes must be above zero"),
    )
    for failed, why in problems:
        if failed:
            raise RuleError(f"rule {rule.id}: {why}")
    return rule


def load_rules(path: str | None = None) -> list[Rule]:
    """Rules of a JSON or YAML file holding ``{"rules": [...]}``; shipped ones by default."""
    if path is None:
        return list(SHIPPED_RULES)
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise RuleError("reading YAML rules needs PyYAML; use JSON instead") from exc
        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text)
    return rules_from_records(data.get("rules", []))


def _tagged(rid, name, severity, tag, mitre, about, window=60):
    return {
        "id": rid, "name": name, "severity": severity, "type": "match",
        "window_minutes": window, "where": {"tags__in_tags": tag}, "mitre": mitre,
        "description": about,
    }


def _logins(rid, name, service, threshold, about):
    return {
        "id": rid, "name": name, "severity": "high", "type": "threshold",
        "window_minutes": 10, "threshold": threshold,
        "where": {"service": service, "event_type": "auth_attempt"},
        "mitre": ["T1110.001"], "description": about,
    }


# --- fixed values: shipped rules --------------------------------------------
SHIPPED_RULES = rules_from_records(
    [
        _logins("ssh_bruteforce", "SSH brute-force", "ssh", 20,
                "Twenty or more SSH login attempts by one source in ten minutes."),
        _logins("telnet_bruteforce", "Telnet brute-force", "telnet", 15,
                "Fifteen or more telnet login attempts by one source in ten minutes."),
        {"id": "credential_stuffing", "name": "Credential stuffing (many distinct usernames)",
         "severity": "high", "type": "distinct", "window_minutes": 30,
         "distinct_field": "username", "threshold": 15,
         "where": {"event_type": "auth_attempt"}, "mitre": ["T1110.004"],
         "description": "One source working through a list of account names."},
        {"id": "password_spray", "name": "Password spraying (one password, many accounts)",
         "severity": "high", "type": "distinct", "window_minutes": 60,
         "group_by": "password", "distinct_field": "username", "threshold": 10,
         "where": {"event_type": "auth_attempt"}, "mitre": ["T1110.003"],
         "description": "One password tried on many accounts."},
        _tagged("iot_default_credentials", "IoT default credentials used", "critical",
                "iot-default-credential", ["T1078.001"], "A factory login pair was submitted."),
        {"id": "shell_access_granted", "name": "Interactive shell obtained",
         "severity": "critical", "type": "match", "group_by": "session_id",
         "where": {"event_type": "auth_success"}, "mitre": ["T1078"],
         "description": "A login succeeded in this session."},
        _tagged("payload_download_attempt", "Second-stage payload fetch", "critical",
                "payload-fetch", ["T1105"], "A download tool was run after login."),
        _tagged("mirai_signature", "Mirai-family command signature", "critical",
                "mirai-signature", ["T1059.004"], "Commands typical of busybox loaders."),
        {"id": "sensitive_file_access", "name": "Credential file access attempt",
         "severity": "high", "type": "match",
         "where": {"event_type": "command", "command__contains": "/etc/shadow"},
         "mitre": ["T1003.008"], "description": "A command named the shadow file."},
        {"id": "web_path_scan", "name": "Web path enumeration", "severity": "medium",
         "type": "distinct", "window_minutes": 10, "distinct_field": "path", "threshold": 30,
         "where": {"service": "http"}, "mitre": ["T1595.003"],
         "description": "One source requesting many different paths."},
        _tagged("log4shell_attempt", "Log4Shell (JNDI) exploitation attempt", "critical",
                "log4shell", ["T1190"], "A JNDI lookup string was sent."),
        _tagged("shellshock_attempt", "Shellshock exploitation attempt", "critical",
                "shellshock", ["T1190"], "A function-definition payload was sent."),
        _tagged("sql_injection", "SQL injection attempt", "high", "sql-injection", ["T1190"],
                "A request carried SQL injection syntax."),
        _tagged("path_traversal", "Path traversal attempt", "high", "path-traversal",
                ["T1083"], "A request climbed out of its directory."),
        _tagged("secret_file_probe", "Exposed secret file probe", "high", "env-file-probe",
                ["T1552.001"], "A request looked for published secrets."),
        _tagged("webshell_upload", "Webshell upload attempt", "critical", "webshell-upload",
                ["T1505.003"], "A request named a server-side script."),
        {"id": "multi_service_sweep", "name": "Multi-service sweep", "severity": "medium",
         "type": "distinct", "window_minutes": 15, "distinct_field": "service",
         "threshold": 3, "mitre": ["T1046"],
         "description": "One source touching several services in a short time."},
        _tagged("ftp_bounce", "FTP bounce attempt", "high", "ftp-bounce-attempt", ["T1090"],
                "An active-mode transfer to a third party was asked for."),
        {"id": "high_volume_source", "name": "High-volume source", "severity": "medium",
         "type": "threshold", "window_minutes": 5, "threshold": 300, "mitre": ["T1499"],
         "description": "Three hundred or more events of one source in five minutes."},
        {"id": "high_threat_score_source", "name": "High enrichment threat score",
         "severity": "medium", "type": "match", "where": {"threat_score__gte": 40},
         "description": "Enrichment scored an event of this source at 40 or more."},
        _tagged("unusual_http_method", "Unusual HTTP method", "medium", "unusual-method",
                ["T1190"], "A request used a method outside the common set."),
        _tagged("redis_rce_attempt", "Redis RCE / persistence attempt", "critical",
                "redis-rce-payload", ["T1059", "T1053.003"],
                "A Redis SET wrote a key or schedule line."),
        _tagged("redis_dangerous_command", "Redis dangerous command", "high",
                "redis-dangerous", ["T1059"], "A high-risk Redis command was issued."),
        _logins("mysql_bruteforce", "MySQL brute-force", "mysql", 10,
                "Ten or more MySQL login attempts by one source in ten minutes."),
        _tagged("docker_api_enumeration", "Docker API enumeration", "medium", "docker-recon",
                ["T1046"], "An exposed container daemon was enumerated."),
        _tagged("docker_host_mount", "Docker host filesystem mount attempt", "critical",
                "docker-host-mount", ["T1610", "T1611"],
                "A container was asked to mount the host.", 1440),
        _tagged("docker_container_execute", "Docker container start or exec", "critical",
                "docker-execute", ["T1610"], "A container start or exec was asked for.", 1440),
        _tagged("docker_cryptominer_image", "Docker cryptominer image", "critical",
                "docker-cryptominer", ["T1496"], "A known mining image was named.", 1440),
    ]
)
