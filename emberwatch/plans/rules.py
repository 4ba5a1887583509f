"""Detection rules: what to look for, and the shipped rule set."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import timedelta

from emberwatch.operators import predicates as P
from emberwatch.operators.predicates import Predicate


@dataclass(frozen=True)
class Burst:
    """`count` reached inside a sliding window: rows, distinct values, or a total.

    `total` names a numeric field of non-negative amounts, such as a byte count.
    """

    where: Predicate
    group_by: tuple[str, ...]
    within: timedelta
    count: int
    distinct: str | None = None
    total: str | None = None


@dataclass(frozen=True)
class Step:
    label: str
    where: Predicate
    count: int = 1


@dataclass(frozen=True)
class Sequence:
    """Ordered steps that all land within one window of the first event."""

    group_by: tuple[str, ...]
    within: timedelta
    steps: tuple[Step, ...]


@dataclass(frozen=True)
class Travel:
    """Consecutive events of one key from two places, too fast to travel between."""

    where: Predicate
    group_by: tuple[str, ...]
    within: timedelta
    min_km: float
    min_kmh: float


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    mitre_id: str
    mitre_name: str
    description: str
    narrative: str
    detect: Burst | Sequence | Travel
    enabled: bool = True


def armed(rules: Iterable[Rule], disabled: Iterable[str] = ()) -> list[Rule]:
    """The rules that run: enabled ones not named in `disabled`."""
    off = set(disabled)
    return [r for r in rules if r.enabled and r.id not in off]


def disable(rules: Iterable[Rule], ids: Iterable[str]) -> list[Rule]:
    """The same rules with the named ones switched off."""
    off = set(ids)
    return [replace(r, enabled=False) if r.id in off else r for r in rules]


def shipped_rules() -> list[Rule]:
    """The twelve ready-made rules. Ids, thresholds, tags and headlines are fixed values."""
    minutes = lambda n: timedelta(minutes=n)
    hours = lambda n: timedelta(hours=n)
    ssh = P.eq("source", "ssh")
    web = P.eq("source", "web")
    windows = P.eq("source", "windows")
    firewall = P.eq("source", "firewall")
    failure = P.eq("status", "failure")
    success = P.eq("status", "success")
    login = P.eq("action", "login")
    return [
        Rule(
            "ssh-brute-force", "SSH brute force succeeded", "critical",
            "T1110.001", "Brute Force: Password Guessing",
            "Many failed SSH logins from one address that end in an accepted one.",
            "{failed} failed SSH logins from {src_ip} in {span}, then a successful "
            "login as {user}",
            Sequence(
                ("src_ip",), minutes(10),
                (
                    Step("failed", ssh & failure, 8),
                    Step("accepted", ssh & login & success),
                ),
            ),
        ),
        Rule(
            "ssh-password-spray", "SSH password spraying", "high",
            "T1110.003", "Brute Force: Password Spraying",
            "One address failing against many accounts, few tries for each.",
            "{src_ip} failed against {distinct} different accounts in {span} ({users})",
            Burst(ssh & failure, ("src_ip",), minutes(10), 6, distinct="user"),
        ),
        Rule(
            "firewall-port-scan", "Horizontal port scan", "medium",
            "T1046", "Network Service Discovery",
            "Blocked connections from one address to many destination ports.",
            "{src_ip} touched {distinct} distinct ports in {span}",
            Burst(
                firewall & P.eq("status", "blocked"), ("src_ip",), minutes(5), 15,
                distinct="port",
            ),
        ),
        Rule(
            "web-content-discovery", "Web content discovery", "medium",
            "T1595.003", "Active Scanning: Wordlist Scanning",
            "One client asking for many different paths that do not exist.",
            "{src_ip} requested {distinct} missing paths in {span}",
            Burst(web & P.eq("http_status", 404), ("src_ip",), minutes(5), 20, distinct="path"),
        ),
        Rule(
            "web-sqli", "SQL injection attempt", "high",
            "T1190", "Exploit Public-Facing Application",
            "Well-known SQL injection fragments in a request path or query.",
            "{count} SQL injection payloads from {src_ip} ({paths})",
            Burst(P.matches("path", P.SQLI), ("src_ip",), minutes(10), 1),
        ),
        Rule(
            "web-xss", "Cross-site scripting attempt", "medium",
            "T1059.007", "Command and Scripting Interpreter: JavaScript",
            "Script tags or inline event handlers in a request path or query.",
            "{count} XSS payloads from {src_ip} ({paths})",
            Burst(P.matches("path", P.XSS), ("src_ip",), minutes(10), 1),
        ),
        Rule(
            "web-path-traversal", "Path traversal / local file inclusion", "high",
            "T1083", "File and Directory Discovery",
            "Requests whose decoded path climbs out of the web root.",
            "{count} traversal attempts from {src_ip} ({paths})",
            Burst(P.matches("path", P.TRAVERSAL), ("src_ip",), minutes(10), 1),
        ),
        Rule(
            "impossible-travel", "Impossible travel", "critical",
            "T1078", "Valid Accounts",
            "One account logging in from two places faster than anyone can travel.",
            "{user} logged in from {from} then {to} {gap} later - {km} km apart, {kmh} km/h",
            Travel(login & success, ("user",), hours(4), 700, 900),
        ),
        Rule(
            "privilege-escalation-burst", "Privilege escalation burst", "high",
            "T1068", "Exploitation for Privilege Escalation",
            "Repeated privilege grants or sudo runs by one account in a short time.",
            "{user} picked up elevated rights {count} times in {span}",
            Burst(
                P.eq("action", "priv_assigned") | (P.eq("action", "sudo") & success),
                ("user",), minutes(5), 6,
            ),
        ),
        Rule(
            "admin-group-change", "Account added to privileged group", "high",
            "T1136.001", "Create Account: Local Account",
            "An account was created or became a member of a security-enabled group.",
            "group membership changed for {user} ({count} events in {span})",
            Burst(
                windows & P.one_of("event_id", [4728, 4732, 4720]), ("user",), minutes(15), 1
            ),
        ),
        Rule(
            "audit-log-cleared", "Security audit log cleared", "critical",
            "T1070.001", "Indicator Removal: Clear Windows Event Logs",
            "The security event log of a host was emptied.",
            "audit log cleared on {host} by {user}",
            Burst(windows & P.eq("event_id", 1102), ("host",), hours(1), 1),
        ),
        Rule(
            "data-exfil-volume", "Large outbound transfer", "critical",
            "T1048", "Exfiltration Over Alternative Protocol",
            "A large volume of allowed traffic out of one host in a short time.",
            "{mb} MB left {src_ip} in {span} across {count} allowed flows",
            Burst(
                firewall & P.eq("status", "allowed") & P.exists("bytes"),
                ("src_ip",), minutes(10), 20_000_000, total="bytes",
            ),
        ),
    ]
