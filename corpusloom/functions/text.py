"""Text normalisation as column expressions.

Regular expressions state ``(?U)`` where Unicode classes matter. ``normalize`` hashes
addresses and is not idempotent: apply it once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT

# What the normaliser replaces.
SMART_QUOTES = "‘’“”´′"
ASCII_QUOTES = "''\"\"''"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: White space but the space itself, of ASCII and beyond it.
BLANKS = "\t\n\x0b\x0c\r"
WIDE_BLANKS = "\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
URL_HOST = r"(?:https?|ftp)://[^/\s'\"]+"
PROMPTS = (r"^\s*[\w.\-]+@[\w.\-]+:\S*\s*[#$]\s+", r"^\s*\$\s+", r"^\s*>\s+")
HASHED_HOST = r"\bh[0-9a-f]{8}\.example\.net\b"

#: Cuts a session into quoted strings, separators and the rest; an open quote takes all that follows.
SESSION_TOKEN = r""""[^"]*(?:"|\z)|'[^']*(?:'|\z)|;|\n|&&|\|\||[^'";\n&|]+|[&|]"""
CUT = "\ue000"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that a filter on one of them does not compute it anew for each mention."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def replace_each(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match m of ``pattern`` replaced by ``change(m)``."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda t, m: F.concat(t, F.coalesce(change(m), F.lit("")))), "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def where(text: Column, asked: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts for which ``asked`` holds; the text is computed once."""
    return bound(text, lambda t: F.when(asked(t), change(t)).otherwise(t))


def holds(text: Column, characters: str) -> Column:
    """Whether a text has one of a few characters: each is looked for by its bytes, which costs less than a class of a pattern."""
    return reduce(Column.__or__, [text.contains(c) for c in characters])


def has_runs(text: Column) -> Column:
    """Whether a text has two spaces in a row or other white space."""
    return text.contains("  ") | holds(text, BLANKS) | ((F.octet_length(text) > F.length(text)) & holds(text, WIDE_BLANKS))


def unclean(text: Column) -> Column:
    """Whether a text has what the steps before addresses change."""
    return holds(text, SMART_QUOTES) | text.rlike(r"[\x00-\x1f\x7f]")


def byte_of(digest: Column, k: int) -> Column:
    """Byte k of a hex digest, as a number."""
    return F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")


def fake_ip(ip: Column) -> Column:
    """A stable address in place of another: from its SHA-1, first and last part never 0 or 255."""
    h = F.sha1(ip)
    return F.concat_ws(".", byte_of(h, 0) % 223 + 1, byte_of(h, 1), byte_of(h, 2), byte_of(h, 3) % 254 + 1)


def hash_hosts(text: Column) -> Column:
    """Hosts of urls (all up to a slash, white space or quote) replaced by a hashed name."""
    at = lambda m: F.instr(m, F.lit("://")) + 2
    fake = lambda m: F.concat(F.substring(m, F.lit(1), at(m)), F.lit("h"), F.left(F.sha1(F.lower(m.substr(at(m) + 1, F.length(m)))), F.lit(8)), F.lit(".example.net"))
    return where(text, lambda t: t.contains("://"), lambda t: replace_each(t, "(?iU)" + URL_HOST, fake))


def hash_ips(text: Column) -> Column:
    return where(text, lambda t: t.rlike(r"(?U)\d\.\d"), lambda t: replace_each(t, "(?U)" + IPV4, fake_ip))


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(where(text, has_runs, lambda t: F.regexp_replace(t, r"(?U)\s+", " ")))


def normalize(raw: Column) -> Column:
    clean = lambda t: F.translate(F.regexp_replace(F.translate(t, SMART_QUOTES, ASCII_QUOTES), CONTROL, " "), "\r\n\t", "   ")
    text = where(raw, unclean, clean)
    return collapse(hash_ips(hash_hosts(text)))


def usable(command: Column, lo: int = DEFAULT.min_len, hi: int = DEFAULT.max_len) -> Column:
    """Of a sensible length and no comment."""
    return F.coalesce(F.length(command).between(lo, hi) & ~F.startswith(F.ltrim(command), F.lit("#")), F.lit(False))


def strip_addresses(command: Column) -> Column:
    """Addresses and hashed hosts replaced by constants, for the ablation."""
    return F.regexp_replace(F.regexp_replace(command, "(?U)" + IPV4, "ADDR"), "(?U)" + HASHED_HOST, "HOST")


def atoms(session: Column) -> Column:
    """A session's commands: cut at ; newline && || outside quotes, trimmed, empties dropped."""
    tokens = F.regexp_extract_all(session, F.lit(SESSION_TOKEN), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(t.isin(";", "\n", "&&", "||"), F.lit(CUT)).otherwise(t))
    pieces = F.transform(F.split(F.array_join(marked, ""), CUT), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


def unterminated_quote(command: Column) -> Column:
    quotes = "['\"]"
    return F.when(command.rlike(quotes), F.regexp_replace(command, "\"[^\"]*\"|'[^']*'", "").rlike(quotes)).otherwise(command.isNull() & F.lit(None).cast("boolean"))


def unescape_html(text: Column) -> Column:
    """The five named entities and the numeric apostrophe; the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_prompt(text: Column) -> Column:
    """A leading ``user@host:path$``, ``$`` or ``>`` prompt, with the blanks before and after it."""
    for prompt in PROMPTS:
        text = F.regexp_replace(text, "(?U)" + prompt, "")
    return text


def strip_comment(text: Column) -> Column:
    """What stands before a ``#`` that follows a blank outside quotes; an open quote takes all that follows.

    The text is cut into quoted strings and pieces of the rest; the first of these with a
    comment ends it. No pattern nests, so texts of any length are fine.
    """
    tokens = F.regexp_extract_all(text, F.lit(r""""[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[ \t]++#?|[^"' \t]++"""), F.lit(0))
    at = F.array_position(F.transform(tokens, lambda t: t.rlike(r"^[ \t]+#$")), True).cast("int")
    kept = F.regexp_replace(F.array_join(F.slice(tokens, 1, F.greatest(at - 1, F.lit(0))), ""), r"(?U)\s+$", "")
    return F.when(text.rlike(r"[ \t]#") & (at > 0), kept).otherwise(text)


def fill_placeholders(text: Column, values: dict[str, str]) -> Column:
    """Every key replaced by its value, in order."""
    for key, value in values.items():
        text = F.replace(text, F.lit(key), F.lit(value))
    return text


def resolve_arguments(text: Column, defaults: Column, passes: int = 4) -> Column:
    """``#{name}`` replaced from a map of defaults, repeatedly as defaults may name others."""
    for _ in range(passes):
        text = F.aggregate(F.map_entries(defaults), text, lambda a, e: F.replace(a, F.concat(F.lit("#{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return text


def unwrap_braces(text: Column) -> Column:
    """``{{x}}`` to x."""
    return F.regexp_replace(text, r"\{\{(.*?)\}\}", "$1")


def strip_fence(text: Column) -> Column:
    """A Markdown fence around the whole text."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[\w-]*\s*\n?", ""), r"\n?\s*```\s*$", ""))


def join_continuations(text: Column, pairs: bool = True) -> Column:
    """Lines that end in a backslash (blanks may follow it) joined with the next by one space.

    With ``pairs`` only an odd number of backslashes counts. A joined line loses the blanks
    around its cuts; a line that holds nothing but its backslash leaves the next as it is,
    and a last line that ends in one loses it.

    A mark is put where a line goes on, and then taken with the blanks around it, in time that
    follows the text. That is wrong only where what a cut leaves ends in a backslash again
    and a blank line comes next; texts with such a cut are folded line by line.
    """
    again = r"(?U)\\[^\S\n]+\\[^\S\n]*\n" if pairs else r"(?U)\\[^\S\n]*\\[^\S\n]*\n"
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r+$", ""))
    tail = lambda x: F.length(F.regexp_extract(x, r"(?U)(\\*)\s*$", 1))
    more = (lambda x: tail(x) % 2 == 1) if pairs else (lambda x: tail(x) > 0)
    less = lambda x: F.regexp_replace(x, r"(?U)\s*\\\s*\z", "")
    marked = F.array_join(F.transform(lines, lambda x: F.when(more(x), F.concat(less(x), F.lit(CUT))).otherwise(F.concat(x, F.lit("\n")))), "")
    cuts = rf"(?:{CUT}[^\S\n]*+)+"
    ended = F.regexp_replace(F.regexp_replace(marked, rf"(?U)[^\S\n]*+{cuts}\z", ""), r"\n\z", "")
    whole = F.when(F.endswith(marked, F.lit(CUT)), ended).otherwise(F.regexp_replace(marked, r"\n\z", ""))
    whole = F.regexp_replace(whole, rf"(?U)(?<![^\n])(?:[^\S\n]*+{CUT})+", "")
    whole = F.regexp_replace(whole, rf"(?U)(?<![^\n])([^\n{CUT}]*+{CUT}[^\n]*[^\s])[^\S\n]++(?=\n|\z)", "$1")
    fast = F.regexp_replace(whole, rf"(?U)[^\S\n]*+{cuts}", " ")
    return F.when(text.rlike(again), _folded_continuations(lines, pairs)).otherwise(fast)


def _folded_continuations(lines: Column, pairs: bool) -> Column:
    """The same, one line at a time."""
    let = bound
    ends = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    tail = lambda x: F.length(F.regexp_extract(x, r"(\\*)$", 1))
    more = (lambda x: tail(x) % 2 == 1) if pairs else (lambda x: tail(x) > 0)

    def step(held: Column, x: Column) -> Column:
        def of(s: Column) -> Column:
            cut = let(ends(s), lambda e: F.when(more(e), ends(F.left(e, F.length(e) - 1))))
            return let(cut, lambda c: F.struct(F.coalesce(c, F.lit("")).alias("open"), F.when(c.isNull(), F.concat(held["out"], s, F.lit("\n"))).otherwise(held["out"]).alias("out")))

        return let(F.when(held["open"] != "", F.concat(held["open"], F.lit(" "), F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))).otherwise(x), of)

    start = F.struct(F.lit("").alias("open"), F.lit("").alias("out"))
    return F.aggregate(lines, start, step, lambda s: F.regexp_replace(F.concat(s["out"], F.when(s["open"] != "", F.concat(s["open"], F.lit("\n"))).otherwise("")), r"\n\z", ""))


def substituted(text: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``text`` after every (pattern, replacement) in turn, and whether that changed it."""
    out = text
    for pattern, into in rules:
        out = F.regexp_replace(out, pattern, into)
    return out, ~out.eqNullSafe(text)
