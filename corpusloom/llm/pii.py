"""Personal data and secrets in text: patterns propose, checksums confirm, context adjusts the score.

Only DataFrame functions. Every kind has a pattern that proposes spans (leftmost,
not overlapping within the kind), a validator (address ranges, digit counts, Luhn,
mod 97, the look of a key) and a base score, which nearby words of the kind raise. A span
stays when its score reaches the threshold; the four base kinds start at or above it, so
that for them context only ranks.

Beyond the base kinds: IBANs (mod 97), social security numbers near words that say so,
keys of known issuers (prefix and length), JSON web tokens, private key blocks, and runs
of 16 or more characters of base64 or hex that mix letters and digits, of at least eight
different characters, if a word like token, password or key stands before or in them. Those
kinds propose whole runs of their characters, and the validator looks at the run.

Positions are code points, end exclusive. The patterns use possessive groups, which
Java runs in a loop, and start only where a run of their characters starts: texts of
any length take linear time and no deep stack. Null text counts as empty; equal rows
get equal results; an empty table gives no rows. Columns of any name may come along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import running_totals, settled, wrapped

THRESHOLD = 0.5
#: Code points before a span in which context words count, beside the span itself.
NEAR = 40
CONTEXT_BONUS = 0.3
BASE = ("email", "ip", "card", "phone")
_MAIL = r"[A-Za-z0-9._%+-]"
#: kind: (pattern, cheap test that a text may hold it, base score, context words)
KINDS: dict[str, tuple[str, str, float, str]] = {
    "email": (rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.7, r"mail|contact|write|address"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", 0.7, r"card|visa|credit|payment|account"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|call|tel|mobile|fax"),
    "iban": (r"[A-Za-z0-9]{15,}+", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", 0.6, r"iban|bank|account|transfer"),
    "ssn": (r"[0-9-]{11,}+", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"ssn|social|security|tax"),
    "key": (r"[A-Za-z0-9_-]{20,}+", r"AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|[sr]k_live_|AIza|glpat-|npm_|hf_", 0.8, r"key|token|secret|auth"),
    "jwt": (r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", r"eyJ[A-Za-z0-9_-]", 0.8, r"token|bearer|auth"),
    "pem": (r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", r"PRIVATE KEY-----", 0.9, r"key"),
    "secret": (r"[A-Za-z0-9_+/=-]{16,}+", r"[A-Za-z0-9_+/=-]{16}", 0.3, r"token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|credential|bearer"),
}
#: Keys of known issuers, as a whole run.
ISSUED = r"^(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{50,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,})$"
#: Different characters of a run that may be a secret, at least.
DIFFERENT = 8
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    right = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = right.substr(i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(right)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits fit."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban) - 4), iban.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), turned.substr(i, F.lit(1))) - 1
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.when(m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), mod97(m)).otherwise(False)
    if kind == "ssn":
        return m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "key":
        return m.rlike(ISSUED)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= DIFFERENT)
    return F.lit(True)


def _accepted(kind: str, threshold: float) -> Column:
    """The spans of one kind that its validator and the score accept, from the columns of with_spans."""
    _, _, score, near = KINDS[kind]

    def span(h: Column, i: Column) -> Column:
        before = F.get(f"_p_{kind}", i)
        start = F.get(f"_b_{kind}", i) + F.length(before)
        said = F.right(F.concat(F.coalesce(F.get(f"_h_{kind}", i - 1), F.lit("")), before), F.lit(NEAR))  # the span before may hold the word
        bonus = F.when(F.lower(F.concat(said, h)).rlike(near), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), (start + F.length(h)).cast("long").alias("end"), (F.lit(score) + bonus).alias("score"), h.alias("_m"))

    spans = F.filter(F.transform(f"_h_{kind}", span), lambda s: (s["score"] >= threshold) & _valid(kind, s["_m"]))
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return F.coalesce(spans, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def with_spans(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``pii``: an array of (kind, start, end, score), by kind as in KINDS and then by start."""
    columns = [c for c in df.columns if c != "pii"]  # a column of that name is replaced
    rows = wrapped(df.select(*[F.col(f"`{c}`") for c in columns]), _text=text) if columns else df
    t = F.coalesce(F.col("_text"), F.lit(""))
    rows = settled(rows, **{f"_p_{k}": F.when(t.rlike(test), F.split(t, p, -1)) for k, (p, test, _, _) in KINDS.items()}, **{f"_h_{k}": F.when(t.rlike(test), F.regexp_extract_all(t, F.lit(p), F.lit(0))) for k, (p, test, _, _) in KINDS.items()})
    rows = settled(rows, **{f"_n_{k}": F.zip_with(F.slice(f"_p_{k}", 1, F.size(f"_h_{k}")), f"_h_{k}", lambda p, h: (F.length(p) + F.length(h)).cast("long")) for k in KINDS})
    rows = settled(rows, **{f"_b_{k}": F.when(F.size(f"_n_{k}") > 0, running_totals(F.col(f"_n_{k}"))) for k in KINDS})
    found = settled(rows, pii=F.concat(*[_accepted(k, threshold) for k in KINDS]))
    return found.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns], "pii")


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` of with_spans with ``clean``: every span's text replaced by ``[KIND]``, overlaps merged by start."""
    t = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), F.length(t))),
    )
    return df.withColumn("clean", out)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, all spans as text, their number, whether there is one."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    df = with_spans(narrow).drop("text")
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("pii", _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    more = F.size("pii").cast("long")
    return df.select("doc_id", *counts, F.sha2(show(base), 256).alias("base_sha256"), show("pii").alias("spans"), more.alias("n_spans"), (more > 0).alias("flagged"))
