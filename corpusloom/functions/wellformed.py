"""Label-independent rules of well-formedness: names and predicates over text only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import holds, once, unterminated_quote

# The patterns of the rules.
TERMINAL = r"[\x1b\x07\x08]"
CARET = r"^\^[A-Z@\[\]\\^_]|\^[A-Z@\[\]\\^_]\z"
SPACED_ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_.\[\]'\"]*\s+=\s"
JSON_MEMBER = r"^[\"'][^\"']*[\"']\s*:"
MARKUP = r"^<!|^</?[A-Za-z][A-Za-z0-9]*\s*/?>|^<[A-Za-z][A-Za-z0-9]*\s+[A-Za-z:_-]+\s*="
BLOCK = r"^(?:def|class|elif|else|try|except|finally|with|lambda|@\w+|pass|import|from)\b[^;]*:\z"
WORD = r"[A-Za-z0-9_]"
PROMPT = r"^[A-Za-z][A-Za-z ]{2,}:\z"
SCRUB = r"(wget|curl)[^|]*\|\s*(ba)?sh\b|/dev/(tcp|udp)/|\bnc\b[^|;]*\s-\w*e\w*\s|(bash|sh)\s+-i\s*>&|>>?\s*[^\s;]*authorized_keys|\bchpasswd\b|history\s+-c|\brm\s+-[rRf]{2,}\s+/(\s|\z)"
MARKERS = r"(wget|curl|tftp|ftpget|\bscp\b)|\|\s*(sh|bash)\b|chmod\s+(\+?x|777|755)|/dev/(tcp|udp)/|\bnc\b[^|]*-e\b|(bash|sh)\s+-i\b|authorized_keys|echo\s+ssh-rsa|\bcrontab\b|chpasswd|history\s+-c|>\s*/var/log|\brm\s+-rf\s+/"
INNOCUOUS = r"cd(?:\s+[^\s;|&<>$`()]+)?|ls(?:\s+-[A-Za-z]+)*(?:\s+[^\s;|&<>$`()]+)?|pwd|whoami|id|w|who|users|tty|date|uptime|hostname|logname|exit|logout|clear|history|nproc|lscpu|lsblk|arch|uname(?:\s+-[A-Za-z]+)*|ps(?:\s+-?[A-Za-z]+)*|(?:df|du|free|last|env|printenv|top)(?:\s+-[A-Za-z]+)*|cat\s+/proc/(?:cpuinfo|meminfo|version|uptime|stat|loadavg)"

RULES = {
    "W1_unterminated_quote": lambda c, raw: unterminated_quote(c),
    "W2_terminal_control": lambda c, raw: raw.rlike(TERMINAL) | (c.contains("^") & c.rlike("(?U)" + CARET)),
    "W3_spaced_assignment": lambda c, raw: c.rlike("(?U)" + SPACED_ASSIGNMENT),
    "W4_json_member": lambda c, raw: c.rlike("(?U)" + JSON_MEMBER),
    "W5_markup_tag": lambda c, raw: F.startswith(c, F.lit("<")) & c.rlike("(?U)" + MARKUP),
    "W6_block_colon": lambda c, raw: c.rlike("(?U)" + BLOCK),
    "W7_no_word_char": lambda c, raw: ~c.rlike(WORD),
    "W8_prompt_phrase": lambda c, raw: c.rlike(PROMPT),
}


def asked_of(raw: Column) -> Column:
    """What the rules ask of a line before it was normalised: itself where it has a terminal's control characters, else nothing."""
    return F.when(holds(raw, "\x1b\x07\x08"), raw).otherwise("")


def violations(command: Column, raw: Column) -> Column:
    """Names of all violated rules, in order."""
    return F.array_compact(F.array(*[F.when(rule(command, raw), F.lit(name)) for name, rule in RULES.items()]))


def well_formed(df: DataFrame, command: str = "command", raw: str = "raw") -> DataFrame:
    return once(df, violations=violations(F.col(command), F.col(raw)))


def needs_scrub(command: Column) -> Column:
    """Unambiguous attack forms, for normal rows only."""
    return command.rlike("(?iU)" + SCRUB)


def has_marker(command: Column) -> Column:
    """The keyword probe; it reports and never gates."""
    return command.rlike("(?iU)" + MARKERS)


def innocuous_alone(command: Column) -> Column:
    return command.rlike(rf"(?iU)^(?:{INNOCUOUS})\s*\z")
