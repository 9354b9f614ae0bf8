"""Pattern catalogues: what to look for in log lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CATALOGUE = 10_000

# The 58 signature patterns, in catalogue order.
SIGNATURES = [
    r"Failed password",
    r"Invalid user",
    r"authentication failure",
    r"sudo:.*incorrect password",
    r"Permission denied",
    r"Account locked out",
    r"Logon failure",
    r"error",
    r"Access denied",
    r'type=SYSCALL.*name="/etc/passwd"',
    r'type=SYSCALL.*name="/etc/shadow"',
    r'type=SYSCALL.*name="/etc/sudoers"',
    r"type=SYSCALL.*syscall=init_module",
    r'type=SYSCALL.*name="/etc/cron\.\w+"',
    r'type=SYSCALL.*name="/var/spool/cron/\w+"',
    r"ScriptBlockText.*Invoke-Expression",
    r"ScriptBlockText.*IEX",
    r"ScriptBlockText.*DownloadString",
    r"ScriptBlockText.*Base64",
    r"ScriptBlockText.*EncodedCommand",
    r"ParentImage.*\\Temp\\",
    r"ParentImage.*\\AppData\\",
    r"ParentImage.*\\Windows\\Temp\\",
    r"Image.*cmd\.exe",
    r"Image.*powershell\.exe",
    r"Image.*wscript\.exe",
    r"Image.*cscript\.exe",
    r"Image.*mshta\.exe",
    r"Image.*rundll32\.exe",
    r"Image.*regsvr32\.exe",
    r"DestinationIp.*malicious",
    r"Task Content.*powershell",
    r"Task Content.*cmd",
    r"Task Content.*wscript",
    r"Task Content.*mshta",
    r"Task Content.*rundll32",
    r"Task Content.*regsvr32",
    r"Task Content.*\\Temp\\",
    r"TargetObject.*\\Run\\",
    r"TargetObject.*\\RunOnce\\",
    r"Details.*\.exe",
    r"Details.*\.dll",
    r"Details.*\.ps1",
    r"Details.*\.vbs",
    r"Details.*\.js",
    r"Details.*\.hta",
    r"SourceImage.*wmic\.exe",
    r"SourceImage.*powershell\.exe",
    r"SourceImage.*cscript\.exe",
    r"TargetImage.*svchost\.exe",
    r"GET.*\.(php|jsp|asp|aspx)\?.*(cmd|exec|system|passthru|shell_exec|eval|assert|base64_decode)",
    r"GET.*(select|union|insert|delete|update|drop|--|'|\"|%27|%22)",
    r"CPU.*> 80",
    r"duration.*> 30",
    r"Failed logon.*Status.*0xC0000064",
    r"Failed logon.*Status.*0xC000006A",
    r"Failed logon.*Status.*0xC0000234",
    r"Failed logon.*Status.*0xC0000072",
]

# Phrases that mark an authentication failure, and the tags such lines get.
AUTH_FAILURES = [
    "failed",
    "failure",
    "invalid password",
    "authentication error",
    "login failed",
    "authentication rejected",
]
AUTH_FAILURE_TAGS = ["auth", "failed"]

# The two built-in line shapes.
FAILED_LOGIN_LINE = r"Failed password for .* from (\d+\.\d+\.\d+\.\d+)"
PROCESS_LINE = r"EXEC: (.*) \[PID: (\d+)\]"


@dataclass(frozen=True)
class LinePattern:
    """A catalogue row. Named groups ``ip``, ``user``, ``process`` and ``port`` become columns."""

    pattern: str
    type: str = "log_line"
    tags: tuple[str, ...] = ()


def signature_patterns() -> list[LinePattern]:
    return [LinePattern(pattern) for pattern in SIGNATURES]


def catalogue_rows(df: DataFrame) -> list[LinePattern]:
    """A catalogue table (ordinal, pattern, and optionally type and tags) as patterns for the line operators.

    A catalogue here is configuration of a few dozen rows; a larger table than ``MAX_CATALOGUE`` is refused.
    ``operators.signatures`` takes tables of any size.
    """
    rows = df.orderBy("ordinal").limit(MAX_CATALOGUE + 1).collect()
    if len(rows) > MAX_CATALOGUE:
        raise ValueError(f"a pattern catalogue may have at most {MAX_CATALOGUE} rows")
    found = [row.asDict() for row in rows]
    return [
        LinePattern(row["pattern"], row.get("type") or "log_line", tuple(row.get("tags") or ())) for row in found
    ]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file ``{"patterns": [...]}`` as (ordinal, pattern)."""
    rows = spark.read.schema("patterns array<string>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("patterns").alias("ordinal", "pattern"))
