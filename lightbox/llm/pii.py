"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Base kinds (email, ip, card, phone) are found exactly as their contract says and always stay.
The method adds kinds of its own if their score reaches ``THRESHOLD``: a score starts from the
kind, rises with a confirmed check (Luhn, mod 97, for secrets the entropy of their characters) and
with words of the kind near the match. ``key`` are credentials with a form of their own, ``secret``
any run of letters and digits that looks random and that a word such as token or password is assigned to or
stands near; such a word alone, or a random run alone (a digest, an id), isn't enough. Only DataFrame functions are used. Positions come from the lengths of the pieces between the
matches, so each pattern scans a text once, and once more only where it matched.

Patterns are written with possessive quantifiers and a look-behind (or the end of the last
match), which gives the leftmost matches of the plain patterns without their backtracking: time
stays linear and the stack flat on very long texts.

Defined results: a null text is an empty one (``redact`` leaves it null); rows are judged one by one, so nulls, ties and
repeated rows in other columns change nothing; an empty table gives an empty result. ``redact`` passes all columns other
than text and n_chars through whatever their names; ``find`` leaves out columns of ``docs`` that have its results' names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, named, other_names, sums_before

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["card_short", "iban", "ssn", "key", "secret"]
THRESHOLD = 0.8

LOCAL = "A-Za-z0-9._%+-"
# The patterns of the base kinds (same language as the contract's) and of the added ones.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": (
        r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36,255}+|github_pat_[A-Za-z0-9_]{22,255}+|glpat-[A-Za-z0-9_-]{20,255}+|xox[abprs]-[A-Za-z0-9-]{10,255}+"
        r"|sk-[A-Za-z0-9_-]{20,255}+|[rs]k_live_[A-Za-z0-9]{16,255}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,4096}+\.eyJ[A-Za-z0-9_-]{8,4096}+\.[A-Za-z0-9_-]{8,4096}+)(?![A-Za-z0-9])"
        r"|-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]++-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?"
    ),
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{8,}+={0,2}+",
}
# Words that a secret is assigned to.
SECRET_WORDS = r"(?i:token|passw(?:or)?d|passphrase|passcode|\bpwd\b|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authorization|contraseña|passwort|kennwort|mot de passe)"
# A text without any of these parts has no match of the kind (for secrets: of its words, in lower case).
MARKS = {"email": ["@"], "phone": ["+"], "ssn": ["-"], "ip": ["."], "key": ["AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "xox", "sk-", "k_live_", "AIza", "eyJ", "PRIVATE KEY-----"]}
SECRET_MARKS = ["token", "passw", "passphrase", "passcode", "pwd", "secret", "api", "access", "private", "credential", "bearer", "authorization", "contraseña", "kennwort", "passe"]
#: A secret's word is assigned to it if only these signs stand between them.
ASSIGNED = SECRET_WORDS + r"""[\"']?\s*(?:\b(?:is|ist|est|es)\b)?\s*(?:=>|:=|[=:])?\s*[\"']?$"""
LONGEST_SECRET, LEAST_BITS, LONG_SECRET = 512, 3.0, 32
#: A run of so many characters that a word is assigned to needs fewer bits a character, as short random ones repeat some.
ASSIGNED_LENGTH, ASSIGNED_BITS = 12, 2.0
# Starting scores, gain of a confirmed checksum, and words that raise a score when near.
START = {"email": 0.9, "ip": 0.8, "card": 0.4, "phone": 0.8, "iban": 0.4, "ssn": 0.4, "card_short": 0.2, "key": 0.9, "secret": 0.0}
CHECKED = {"card": 0.5, "iban": 0.4, "card_short": 0.3}
CONTEXT_GAIN = {"email": 0.1, "ip": 0.2, "card": 0.1, "phone": 0.2, "iban": 0.2, "ssn": 0.5, "card_short": 0.4, "key": 0.1, "secret": 0.3}
#: A secret's further gains: random characters, a long run of them, and a word that it is assigned to.
RANDOM_GAIN, LONG_GAIN, ASSIGNED_GAIN = 0.3, 0.2, 0.2
CONTEXT = {
    "email": "mail|contact",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|master|karte|carte|tarjeta|payment",
    "card_short": "card|amex|american express|diners|karte|carte|tarjeta",
    "phone": r"phone|call|\btel|mobile|fax|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax id|taxpayer",
    "key": SECRET_WORDS,
    "secret": SECRET_WORDS,
}
BEFORE, AFTER = 48, 24

SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.translate(digits, "0123456789", "0246813579")
    n = F.length(digits)
    at = lambda s, i: F.substring(s, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, at(doubled, i)).otherwise(at(digits, i)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a string of A-Z and 0-9 passes the mod-97 check after its first four characters move to the end."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda r, c: F.when(c == "", r).when(c <= "9", (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    return value == 1


def _matches(text: Column, kind: str) -> Column:
    """All matches of the kind's pattern: (match, start, end, before, after), code points, end exclusive."""
    pattern = PATTERNS[kind]
    empty = F.array().cast("array<struct<match:string,start:bigint,end:bigint,before:string,after:string>>")

    def placed(s: Column) -> Column:
        parts, found = s["parts"], s["found"]
        steps = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        return let(
            sums_before(steps),
            lambda sums: F.transform(
                found,
                lambda m, i: let(
                    sums[i] + F.length(parts[i]),
                    lambda start: F.struct(
                        m.alias("match"), start.alias("start"), (start + F.length(m)).alias("end"),
                        F.right(parts[i], F.lit(BEFORE)).alias("before"), F.left(parts[i + 1], F.lit(AFTER)).alias("after"),
                    ),
                ),
            ),
        )

    some = let(F.split(text, pattern, -1), lambda parts: F.when(F.size(parts) > 1, let(F.struct(parts.alias("parts"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found")), placed)).otherwise(empty))
    of, marks = (F.lower(text), SECRET_MARKS) if kind == "secret" else (text, MARKS.get(kind, [""]))
    return F.when(let(of, lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks))), some).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "card_short":
        return let(_digits(match), lambda d: F.when(F.length(d).between(13, 15), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return let(F.replace(match, F.lit(" "), F.lit("")), lambda m: F.length(m).between(15, 34) & mod97(m))
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "secret":
        return F.length(match) <= LONGEST_SECRET
    return F.lit(True)


def entropy(text: Column) -> Column:
    """Bits a character, from how often each of them occurs in the text."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
        return F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * F.log2(k)) / n

    return let(F.split(text, ""), of)


def _scored(kind: str, matches: Column) -> Column:
    """The valid ones of the matches as (kind, start, end, score)."""
    near = lambda m: F.lower(F.concat_ws(" ", m["before"], m["after"])).rlike(CONTEXT[kind])
    gain = lambda condition, much: F.when(condition, F.lit(much)).otherwise(F.lit(0.0))

    def score(m: Column) -> Column:
        from_context = gain(near(m), CONTEXT_GAIN[kind])
        if kind == "secret":
            assigned = m["before"].rlike(ASSIGNED)
            is_random = entropy(m["match"]) >= F.when(assigned & (F.length(m["match"]) >= ASSIGNED_LENGTH), F.lit(ASSIGNED_BITS)).otherwise(F.lit(LEAST_BITS))
            of_form = F.when(is_random, F.lit(RANDOM_GAIN) + gain(F.length(m["match"]) >= LONG_SECRET, LONG_GAIN)).otherwise(F.lit(0.0))
            return F.when(from_context > 0, F.round(from_context + of_form + gain(assigned, ASSIGNED_GAIN), 3)).otherwise(F.lit(0.0))
        return F.lit(START[kind] + CHECKED.get(kind, 0.0)) + from_context

    valid = F.filter(matches, lambda m: _valid(kind, m["match"]))
    return F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score(m).alias("score")))


def spans_of(text: Column) -> Column:
    """A struct of two arrays of spans: ``base`` by kind as listed, then start; ``added`` likewise."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        cards = lambda m: F.struct(_scored("card", m).alias("card"), _scored("card_short", m).alias("card_short"))
        return let(
            let(_matches(t, "card"), cards),
            lambda c: let(
                F.concat(_scored("email", _matches(t, "email")), _scored("ip", _matches(t, "ip")), c["card"], _scored("phone", _matches(t, "phone"))),
                lambda base: F.struct(
                    base.alias("base"),
                    F.filter(
                        F.concat(c["card_short"], *(_scored(k, _matches(t, k)) for k in ADDED_KINDS[1:])),
                        lambda a: (a["score"] >= THRESHOLD) & ~F.exists(base, lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])),
                    ).alias("added"),
                ),
            ),
        )

    return let(text, of)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


RESULTS = ["pii_base", "pii_added"]


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``pii_base`` and ``pii_added``, arrays of (kind, start, end, score)."""
    spans = fresh(docs, "pii")
    found = docs.withColumn(spans, spans_of(F.col("text")))
    return found.select(*named(*other_names(docs, *RESULTS)), *(F.col(spans)[r.split("_")[1]].alias(r) for r in RESULTS))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, or each run of overlapping spans, replaced by ``<KIND>``."""
    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merge(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        return (
            F.when(F.size(out) == 0, F.array(s))
            .when(s["start"] >= F.try_element_at(out, F.lit(-1))["end"], F.concat(out, F.array(s)))
            .otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind")))))
            .cast(span)
        )

    runs = F.aggregate(by_start, F.array().cast(span), merge)
    at = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    pieces = lambda r: F.concat(
        F.transform(r, lambda s, i: F.concat(at(F.when(i > 0, F.get(r, i - 1)["end"]).otherwise(F.lit(0)), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))),
        F.array(F.substring(text, (F.element_at(r, -1)["end"] + 1).cast("int"), F.lit(2147483647))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(runs, lambda r: F.array_join(pieces(r), "")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked, and ``n_chars`` (if there) recounted."""
    spans, new = fresh(docs, "pii"), fresh(docs, "masked")
    found = docs.withColumn(spans, spans_of(F.col("text")))
    both = F.concat(F.col(spans)["base"], F.col(spans)["added"])
    found = found.withColumn(new, F.when(F.col("text").isNotNull(), masked(F.col("text"), both)))
    result = {"text": F.col(new).alias("text"), "n_chars": F.coalesce(F.length(new).cast("long"), F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None}
    return found.select(*(result[c] if c in result else named(c)[0] for c in docs.columns))
