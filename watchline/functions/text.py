"""Column expressions over event text: rule flags, model text, token extraction."""

from pyspark.sql import Column, functions as F

# Phrases and patterns, matched against the lower-cased message.
# (?d) makes "." stop at "\n" only.
FAILED_LOGIN = ("failed password", "login failed")
INVALID_USER = "invalid user"
SUDO_FAILURES = ("not in sudoers", "authentication failure")
RECON_TOOLS = ("nmap", "masscan", "nikto")
DOWNLOADERS = ("wget", "curl")
REMOTE_DOWNLOAD = r"(?d)(wget|curl).*(http|https)://"
SUSPICIOUS_COMMANDS = ("powershell", "cmd.exe", "bash -i", "nc ", "whoami", "net user", "base64")
SCAN_LIKE_TCP = ("tcp_flags=s", "suspicious_tcp_pattern=true")
HIGH_RISK_PORTS = ("dst_port=3389", "dst_port=445", "dst_port=23")
SQL_INJECTION = r"(?d)(payload=.*select.+from|payload=.*union.+select|payload=.*drop table)"
LOGIN_FAILURES = ("failed password", "login failed", "authentication failure")
LOGIN_SUCCESSES = ("accepted password", "session opened", "login successful")
VOLUME_SERVICES = ("tcp", "udp")
VOLUME_TOKENS = ("payload=", "bytes=")


def contains_any(col: Column, phrases) -> Column:
    if not phrases:
        return F.lit(False)
    out = col.contains(phrases[0])
    for phrase in phrases[1:]:
        out = out | col.contains(phrase)
    return out


def rule_conditions(message: Column) -> dict:
    """Flag name -> boolean column, in the order flags are reported.

    Plain phrases are found with contains, and the two real patterns only run where their fixed words occur: regular
    expressions cost far more per row.
    """
    m = F.lower(message)
    return {
        "failed_login": contains_any(m, FAILED_LOGIN),
        "invalid_user": m.contains(INVALID_USER),
        "privilege_escalation": m.contains("sudo") & contains_any(m, SUDO_FAILURES),
        "recon_tool": contains_any(m, RECON_TOOLS),
        "remote_download": contains_any(m, DOWNLOADERS) & m.contains("://") & m.rlike(REMOTE_DOWNLOAD),
        "suspicious_command": contains_any(m, SUSPICIOUS_COMMANDS),
        "scan_like_tcp": contains_any(m, SCAN_LIKE_TCP),
        "high_risk_port": contains_any(m, HIGH_RISK_PORTS),
        "sql_injection_like": m.contains("payload=") & m.rlike(SQL_INJECTION),
    }


def names_where(conditions: dict) -> Column:
    """Array of the names whose condition holds. Joining arrays stays in generated code; array_compact would not."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(F.lit(name))).otherwise(none) for name, cond in conditions.items()])


def rule_flags(message: Column) -> Column:
    return names_where(rule_conditions(message))


def event_text(service, hostname, source_ip, message, flags) -> Column:
    """The flat text the classifiers see."""
    return F.concat(
        F.lit("service="), service, F.lit(" host="), hostname, F.lit(" ip="), source_ip,
        F.lit(" message="), message, F.lit(" flags="), F.array_join(flags, " "))


def row_text(df) -> Column:
    """event_text for a training row; absent or null fields become 'unknown'."""
    def field(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("unknown")) if name in df.columns else F.lit("unknown")

    body = [F.col(c).cast("string") for c in ("message", "text") if c in df.columns]
    message = F.coalesce(*body, F.lit(""))
    return event_text(field("service"), field("hostname"), field("source_ip"), message, rule_flags(message))


def token(message: Column, pattern: str) -> Column:
    """First capture group of pattern, null when the message has none."""
    return F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))


def dst_port(message: Column) -> Column:
    return token(message, r"dst_port=(\d+)")


def dst_host(message: Column) -> Column:
    return token(message, r"dst_ip=(\S+)")


def rpl_parent(message: Column) -> Column:
    return token(F.lower(message), r"rpl_parent=(\S+)")


def forward_count(message: Column) -> Column:
    return token(F.lower(message), r"fwd_count=(\d+)").cast("long")


def is_failed_login(message: Column) -> Column:
    return contains_any(F.lower(message), LOGIN_FAILURES)


def is_successful_login(message: Column) -> Column:
    return contains_any(F.lower(message), LOGIN_SUCCESSES)


def has_dst_port(message: Column) -> Column:
    return message.rlike(r"dst_port=\d+")


def has_dst_ip(message: Column) -> Column:
    return message.rlike(r"dst_ip=\d")


def is_high_volume(service: Column, message: Column) -> Column:
    return service.isin(*VOLUME_SERVICES) & contains_any(F.lower(message), VOLUME_TOKENS)


def is_allowlisted(source_ip: Column, message: Column, ips, keywords) -> Column:
    m = F.lower(message)
    return source_ip.isin(*ips) | contains_any(m, [k.lower() for k in keywords])
