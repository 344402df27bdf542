"""Banks of cleaning rules: what a scraped line goes through, in order, until a rule names the reason to drop it.

A bank is a tuple of steps. A test looks at the line as it is by then, a change rewrites
it. ``passed`` compiles a bank to columns: the line at the end, the first reason (null for
a line that is kept), and for every counted change whether it changed the line. So a
table is read once, and counts per rule and per change are sums over it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


@dataclass(frozen=True)
class Test:
    """Drops a line for ``reason`` if one of ``patterns`` is found in it, or all are ``absent``, but for lines in which ``unless`` is found.

    ``words``: the line is one of these. ``shorter``, ``longer``: its length. ``open_quote``: a quote is not closed.
    """

    reason: str
    patterns: tuple[str, ...] = ()
    absent: bool = False
    unless: str = ""
    words: frozenset[str] = frozenset()
    shorter: int = 0
    longer: int = 0
    open_quote: bool = False


@dataclass(frozen=True)
class Change:
    """Rewrites a line. ``name`` counts the lines that it changes; without one it is not counted."""

    patterns: tuple[tuple[str, str], ...] = ()
    name: str = ""
    values: tuple[tuple[str, str], ...] = ()  # literal placeholders and what stands for them, in one pass
    comment: bool = False  # cuts a comment that is not in quotes


# --- fixed values: the rules of the extractors -------------------------------

IGNORE = "(?i)"
PLACEHOLDER = "<[^<>]*>"
WHITE = Change(((r"\s+", " "), (r"^ | $", "")))
PROMPTS = tuple(Change(((p, ""),)) for p in T.PROMPTS)

HISTORY = (
    WHITE,
    Test("empty", ("^$",)),
    Test("too_long", longer=500),
    Test("no_alnum", ("[A-Za-z0-9]",), absent=True),
    Test("powershell", (IGNORE + r"^(Get-|Set-|New-|Remove-|Invoke-|Import-Module|powershell(\.exe)?\b)",)),
    Test("cmdexe", (IGNORE + r"^([A-Za-z]:\\|cmd(\.exe)?\s|dir\s+[A-Za-z]:\\)",)),
    Test("comment", ("^#",)),
)

FRAGMENTS = frozenset(["do", "done", "fi", "then", "else", "esac", ";;", "}", "{", ")", "(", ";", "&", "fi;", "done;", "EOF", "EOL", "do;", "else;", "then;", '"', "'", "[", "]", "],"])
TECHNIQUE = (
    WHITE,
    Test("empty", ("^$",)),
    Test("fragment", words=FRAGMENTS),
    Test("fragment", (r"^(done|fi|esac|do|then|else)\b",)),
    Test("comment", ("^#",), unless=r"^#\{"),
    Test("unresolved_placeholder", (r"#\{",)),
    Test("open_block", (r"^\s*(if|for|while|until|case|elif|function)\b",), unless=r"(;\s*(done|fi|esac)\b|\bdone\s*$|\bfi\s*$|\besac\s*$)"),
    Test("not_cmdlike", (r"""^[A-Za-z0-9_./$~"'\[({@-]""",), absent=True),
    Test("natural_lang", (r"^\s*(Note|NOTE|This |The |Step \d|You |Please |Ensure |Make sure|Run the|See )",), unless="[|;>/]"),
    Test("too_short", shorter=4),
    Test("status_echo", (r"""^\s*(echo|printf)\s+("[^"]*"|'[^']*'|[A-Za-z0-9 ,.:!-]*)\s*$""",)),
)

BOOK_VALUES = {
    "ip": "10.10.14.14", "IP": "10.10.14.14", "target_ip": "10.10.14.14", "target-ip": "10.10.14.14", "attacker-ip": "10.10.14.14", "ATTACKER-IP": "10.10.14.14", "attacker_ip": "10.10.14.14",
    "rhost": "10.10.14.14", "RHOST": "10.10.14.14", "lhost": "10.10.14.14", "LHOST": "10.10.14.14", "host": "victim.local", "HOST": "victim.local", "hostname": "victim", "server": "victim.local",
    "port": "4444", "PORT": "4444", "ports": "4444", "rport": "4444", "RPORT": "4444", "lport": "4444", "LPORT": "4444",
    "pid": "1234", "PID": "1234", "pid-or-name": "1234", "pid-of-mysleep": "1234", "securityd PID": "1234", "ppid": "1000", "inode_number": "131074", "fd": "3", "FD": "3",
    "file": "/tmp/f", "FILE": "/tmp/f", "filename": "/tmp/f", "path": "/tmp/f", "PATH": "/tmp/f", "dir": "/tmp/d", "directory": "/tmp/d",
    "binary": "/bin/sh", "bin": "/bin/sh", "program": "/bin/sh", "cmd": "id", "command": "id", "COMMAND": "id", "shell_comand": "id", "script": "/tmp/s.sh", "payload": "/tmp/p",
    "user": "user", "username": "user", "USER": "user", "USERNAME": "user", "uid": "1000", "gid": "1000", "group": "users",
    "password": "Passw0rd", "Password": "Passw0rd", "PASSWORD": "Passw0rd", "pass": "Passw0rd", "domain": "example.com", "DOMAIN": "EXAMPLE.COM",
    "url": "http://example.com/", "URL": "http://example.com/", "iface": "eth0", "IFACE": "eth0", "interface": "eth0", "if": "eth0", "name": "name", "NAME": "name", "container": "web",
    "container-name": "web", "container_id": "1a2b3c4d5e6f", "image": "ubuntu:latest", "imagename": "ubuntu:latest", "namespace": "default", "ns": "default", "pod": "mypod", "pod-id": "mypod",
    "module_name": "mymod", "module": "mymod", "key": "AAAA", "KEY": "AAAA", "token": "TOKEN123", "API_TOKEN": "TOKEN123", "version": "1.0",
    "start": "0", "end": "1024", "START_HEAD": "0", "END_HEAD": "1024", "num": "1", "n": "1", "N": "1", "count": "1", "size": "1024",
    "volume": "myvol", "profile-name": "docker-default", "cert-name-keychain": "mycert", "id": "1234", "ID": "1234", "email": "a@example.com", "string": "str",
}
BOOK_WORDS = {"ATTACKER_IP": "10.10.14.14", "ATTACKER": "10.10.14.14", "YOUR_IP": "10.10.14.14", "YOUR_PORT": "4444", "LHOST": "10.10.14.14", "LPORT": "4444", "RHOST": "10.10.14.14", "RPORT": "4444"}
BOOK_FRAGMENTS = FRAGMENTS | frozenset(["EOT", "*/", "/*", "```", "~~~", "..."])
BOOK_OUTPUT = (
    r"^total \d",
    r"^[-dlbcps][rwxsStT@.+-]{9}[.+@]?\s",
    r"^[Uu]id=\d|^[Gg]id=\d|^groups=",
    r"^[a-z_]+_u:[a-z_]+_r:",
    r"^\(gdb\)|^\(lldb\)|^gef\xe2|^pwndbg>",
    r"^\s*(?:0x[0-9a-fA-F]+\b.*){2,}",
    r"^(?:permit|deny)\s+(?:nopass|persist|nolog)\b",
    r"^auth\s+(?:optional|required|sufficient|include)\b",
    r"^\[[A-Za-z][A-Za-z ]*\]$",
    r"^(?:ExecStart|ExecStop|ExecReload|ExecStartPre|WantedBy|After|Before|Description|Type|Restart|RestartSec|Environment|RequiredBy|Requires|Wants|GenericName|Comment|Terminal|Categories|Icon|StartupNotify|User|Group|PIDFile)=",
    r"^[A-Za-z][\w .+-]{0,40}\.\.\.$",
    r"^\s*\d+\s+rows?\s+in\s+set",
    r"^\s*(?:PING|Reply from|64 bytes from)\b",
    r"^\s*(?:total size is|sent \d+ bytes|received \d+ bytes)\b",
)
BOOK_WINDOWS = (
    r"\b(?:Get|Set|New|Remove|Add|Import|Export|Start|Stop|Out|Select|Where|ForEach|Write|Read|Invoke|ConvertTo|ConvertFrom|Enable|Disable|Test|Copy|Move|Rename|Clear|Format|Measure|Register|Unregister|Restart|Resolve|Update|Install|Find|Search)-[A-Z][A-Za-z]+",
    IGNORE + r"\$env:",
    r"\[System\.|\[Net\.|\[Convert\]|::",
    IGNORE + r"-ExecutionPolicy\b|-NoProfile\b|-EncodedCommand\b|-nop\b",
    IGNORE + r"^\s*(?:reg(?:\.exe)?|schtasks|wmic|certutil|bcdedit|vssadmin|bitsadmin|rundll32|regsvr32|mshta|cscript|wscript|icacls|takeown|dism|sc)\b(?:\s+(?:add|query|delete|create|config|/[a-z]|-[a-z]))",
    IGNORE + r"^\s*net\s+(?:user|localgroup|group|view|use|share|accounts)\b",
    IGNORE + r"\bpowershell(?:\.exe)?\b|\bcmd\.exe\b|\bpwsh\b",
    r"[A-Za-z]:\\\\|[A-Za-z]:\\[A-Za-z]",
    IGNORE + r"%(?:SystemRoot|windir|APPDATA|TEMP|USERPROFILE|ProgramFiles|COMSPEC|PATH)%",
)
BOOK = (
    *PROMPTS,
    Test("blank", (r"^\s*$",)),
    Test("comment", (r"^\s*#",), unless=r"^\s*#\{"),
    Change(comment=True),
    WHITE,
    Test("blank", ("^$",)),
    Test("fragment", words=BOOK_FRAGMENTS),
    Test("bare_quoted_literal", (r"""^"[^"]*"$|^'[^']*'$""",)),
    Test("fragment", (r"^(?:done|fi|esac|do|then|else|;;)\b",)),
    Test("markdown", (r"^\s*[-*>]?\s*\[[^\]]+\]\([^)]*\)\s*$", r"^\s*\|.*\|\s*$")),
    Test("output_or_prose", BOOK_OUTPUT),
    Test("open_block", (r"^\s*(?:if|for|while|until|case|elif|function)\b",), unless=r"(?:;\s*(?:done|fi|esac)\b|\bdone\s*$|\bfi\s*$|\besac\s*$|\bdo\s*$|\bthen\s*$|\{\s*$)"),
    Test("not_cmdlike", (r"""^[A-Za-z0-9_./$~"'\[({@!*-]""",), absent=True),
    Test("natural_lang", (r"^\s*(?:Note|NOTE|This |The |That |These |Those |If you|You |Please |Ensure |Make sure|Run the|See |For |When |We |Here |There |It |Then |Now |First|Next|Finally|Example|e\.g\.|i\.e\.|In )",), unless="[|;>/]"),
    Test("windows_syntax", BOOK_WINDOWS),
    Change(values=tuple(BOOK_VALUES.items()), name="placeholder"),
    Change(tuple((rf"\b{k}\b", v) for k, v in BOOK_WORDS.items()), name="bare_word"),
    Test("unresolved_placeholder", (r"(?<!<)<[A-Za-z][A-Za-z0-9_.\- /]{0,30}>", r"\{\{.*?\}\}", r"#\{[^}]+\}", r"%[A-Za-z_][A-Za-z0-9_]*%", IGNORE + r"\bATTACKER\b", r"\bYOUR_[A-Z]+\b", r"\b[LR]HOST\b|\b[LR]PORT\b")),
    Test("unterminated_quote", open_quote=True),
    Test("too_short", shorter=4),
)

SHEET_SUBSTITUTIONS = (
    (IGNORE + r"<\s*(?:LHOST|RHOST|R?HOST|IP|ATTACKER[-_]?IP|ATTACKING[-_]?IP|YOUR[-_]?IP|TARGET[-_]?IP|REMOTE[-_]?HOST|LOCAL[-_]?IP|ATTACKER|attacker|listen[-_]?ip|your[-_]?ip|target[-_]?ip|ip)\s*>", "10.10.14.9"),
    (IGNORE + r"\{\{?\s*(?:LHOST|IP|RHOST)\s*\}?\}", "10.10.14.9"),
    (r"\$\{?(?:LHOST|IP|RHOST)\}?", "10.10.14.9"),
    (IGNORE + r"\[\s*IP\s*\]", "10.10.14.9"),
    (r"\bATTACKER_?IP\b", "10.10.14.9"),
    (IGNORE + r"\bINTERNET_?IP\b", "10.10.14.9"),
    (IGNORE + r"\battacker\.com\b", "10.10.14.9"),
    (IGNORE + r"<\s*(?:LPORT|RPORT|PORT|listen(?:ing)?[-_]?port|your[-_]?port|target[-_]?port|port)\s*>", "4444"),
    (IGNORE + r"\{\{?\s*(?:LPORT|PORT|RPORT)\s*\}?\}", "4444"),
    (r"\$\{?(?:LPORT|PORT|RPORT)\}?", "4444"),
    (IGNORE + r"\[\s*PORT\s*\]", "4444"),
    (r"\bATTACKER_?PORT\b", "4444"),
    (r"\bIP_ADDRESS\b", "10.10.14.9"),
    (IGNORE + r"\[[^\]]*(?:host|ip|target)[^\]]*\]", "10.10.14.9"),
    (IGNORE + r"\[[^\]]*port[^\]]*\]", "4444"),
)
SHEET = (
    Change(((r"^\s+|\s+$", ""), (r"^\$\s+(\S)", "$1"))),
    Test("empty", ("^$",)),
    Test("comment", ("^#",)),
    Test("beyond_ascii", (r"[^\x00-\x7e]",)),
    Test("fragment", (r"""^\s*(do|done|then|fi|else|elif\b.*|esac|;;|\}|\)|EOF|'EOF'|"EOF"|done\s*;|fi\s*;|\{|\bBEGIN\b)\s*$""",)),
    Test("option_only", ("^-",)),
    Test("keystroke", ("^[Cc]trl[+-]",)),
    Test("doc_line", (" : ", "^[A-Za-z][A-Za-z ]{2,}:$")),
    Test("heredoc", (r"""<<-?\s*['"]?[A-Za-z_]""",)),
    Test("open_block", (r"^\s*(for|while|until|if|case)\b",), unless=r"\b(done|fi|esac)\b"),
    Test("output", (IGNORE + r"^\s*(\||\d+/(tcp|udp)\b|PORT\s+STATE|Starting Nmap|Nmap (scan|done)|Host is up|MAC Address|Not shown|Nmap scan report|\[[-+*!]\]|In |After |Then |Note:|Now |On the |The |Victim|Listener|Output|Example|User |permit |\(root\)|may run|Defaults|>>>|\$>|=>|-{3,})",)),
    Test("windows", (IGNORE + r"powershell|Invoke-|\.exe\b|[A-Za-z]:\\\\|IEX\b|Import-Module|New-Object|\bcmd\.exe|rundll32|certutil|\breg\s+add|\bDownloadString|\.dll\b|-nop\b",)),
    *[Change(((p, v),), name=f"substitution_{i:02d}") for i, (p, v) in enumerate(SHEET_SUBSTITUTIONS)],
    Test("placeholder_left", (r"<[A-Za-z][A-Za-z0-9 ._/-]*>|\{\{.*?\}\}|\[[A-Z][A-Z_]{2,}\]",)),
)

BANKS: dict[str, tuple[Test | Change, ...]] = {"history": HISTORY, "technique": TECHNIQUE, "book": BOOK, "sheet": SHEET}


# --- compiling ---------------------------------------------------------------


def unicode_pattern(pattern: str) -> str:
    """The pattern with classes that know all letters and blanks."""
    return "(?iU)" + pattern.removeprefix(IGNORE) if pattern.startswith(IGNORE) else "(?U)" + pattern


#: What a class or boundary of the patterns means where only ASCII counts.
_ASCII = {r"\b": r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", r"\w": "A-Za-z0-9_", r"\d": "0-9", r"\s": r"\t\n\f\r "}


def ascii_pattern(pattern: str) -> str:
    """The pattern with boundaries and classes that know ASCII alone, as SQL's dialect reads it: an accented letter ends a word."""
    flags, rest = ("(?diu)", pattern.removeprefix(IGNORE)) if pattern.startswith(IGNORE) else ("(?d)", pattern)
    out, inside = [], False
    for t in re.findall(r"\\.|.", rest, re.DOTALL):
        inside = (inside or t == "[") and t != "]"
        out.append(t if t not in _ASCII else _ASCII[t] if inside or t == r"\b" else f"[{_ASCII[t]}]")
    return flags + "".join(out)


def fails(test: Test, s: Column, read: Callable[[str], str] = unicode_pattern) -> Column:
    found = None
    for p in test.patterns:
        hit = s.rlike(read(p))
        found = hit if found is None else found | hit
    if test.absent:
        found = ~found
    if test.words:
        found = s.isin(sorted(test.words))
    if test.shorter:
        found = F.length(s) < test.shorter
    if test.longer:
        found = F.length(s) > test.longer
    if test.open_quote:
        found = T.unterminated_quote(s)
    return found & ~s.rlike(read(test.unless)) if test.unless else found


def changed(change: Change, s: Column, read: Callable[[str], str] = unicode_pattern) -> Column:
    if change.comment:
        return T.strip_comment(s)
    if change.values:
        table = F.create_map(*[F.lit(x) for k, v in change.values for x in (f"<{k}>", v)])
        filled: Callable[[Column], Column] = lambda m: F.coalesce(F.try_element_at(table, m), m)
        return F.when(s.rlike(PLACEHOLDER), T.replace_each(s, PLACEHOLDER, filled)).otherwise(s)
    for pattern, into in change.patterns:
        s = F.regexp_replace(s, read(pattern), into)
    return s


def counted(bank: tuple[Test | Change, ...]) -> list[str]:
    """Names of the changes that are counted."""
    return [x.name for x in bank if isinstance(x, Change) and x.name]


def passed(df: DataFrame, bank: tuple[Test | Change, ...], column: str, read: Callable[[str], str] = unicode_pattern) -> DataFrame:
    """``df`` with clean, reason and changes (a flag for each counted change, of lines that came so far). ``read`` says what the patterns' classes mean."""
    out = df.withColumns({"_s0": F.col(column), "_r0": F.lit(None).cast("string")})
    n, flags, reason = 0, [], F.lit(None).cast("string")
    for step in bank:
        if isinstance(step, Test):
            reason = F.coalesce(reason, F.when(fails(step, F.col(f"_s{n}"), read), step.reason))
            continue
        # what is known by now becomes a column of its own, so that no step is computed twice
        out = out.withColumns({f"_s{n + 1}": changed(step, F.col(f"_s{n}"), read), f"_r{n + 1}": F.coalesce(F.col(f"_r{n}"), reason)})
        n, reason = n + 1, F.col(f"_r{n + 1}")
        if step.name:
            flags.append(F.col(f"_r{n}").isNull() & (F.col(f"_s{n}") != F.col(f"_s{n - 1}")))
    out = out.withColumns({"clean": F.col(f"_s{n}"), "reason": F.coalesce(F.col(f"_r{n}"), reason), "changes": F.array(*flags) if flags else F.array().cast("array<boolean>")})
    return out.drop(*[f"_{c}{i}" for c in "sr" for i in range(n + 1)])


def rule_counts(df: DataFrame, bank: tuple[Test | Change, ...], column: str, read: Callable[[str], str] = unicode_pattern) -> DataFrame:
    """(kind, name, n): lines kept, lines dropped for each reason, and lines that each counted change rewrote; one pass."""
    rows = passed(df, bank, column, read)
    names = counted(bank)
    told = F.concat(
        F.array(F.when(F.col("reason").isNull(), F.struct(F.lit("kept").alias("kind"), F.lit("kept").alias("name"))).otherwise(F.struct(F.lit("dropped").alias("kind"), F.col("reason").alias("name")))),
        *[F.array(F.when(F.get("changes", F.lit(i)), F.struct(F.lit("changed").alias("kind"), F.lit(name).alias("name")))) for i, name in enumerate(names)],
    )
    return rows.select(F.inline(F.array_compact(told))).groupBy("kind", "name").agg(F.count("*").alias("n"))
