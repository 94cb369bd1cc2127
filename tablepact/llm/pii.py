"""Personal data by weak supervision, on column functions alone.

Patterns propose candidates in every text. Labelers, which look at a candidate's pattern, at gazetteers and
at its context, each vote for, against or not at all. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, for each kind, and from that how likely each vote pattern
means personal data. With these likelihoods as soft labels a naive Bayes classifier over the shape and
surroundings of a span is trained; it decides which candidates are added to the base spans, which
always stay.

The driver gets counts of (kind, votes, feature, value) only: at most 9 kinds x 3^6 votes x 6
features x 5 values, whatever the number of texts.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import marker, stored
from tablepact.llm.spans import located

#: Base kinds in the order that breaks ties of spans: fixed values.
BASE_KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that a failed start is not tried again within the same run of
# characters (a later start there fails alike), and without recursion over repeated groups.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Kinds that the method adds.
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]{2,63}+\x20?+[=:]\x20?+[\"']?+(?!//)[A-Za-z0-9+/_.-]{8,}+"
LOCAL_PHONE = r"(?<![0-9A-Za-z.+-])(?![0-9]{4}-[0-9]{2}-[0-9]{2})\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,4}){2,4}+(?![0-9A-Za-z])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

GIVEN_NAMES = """james john robert michael william david richard joseph thomas charles mary patricia jennifer linda
elizabeth barbara susan jessica sarah karen anna maria peter hans klaus jurgen wolfgang heike sabine petra jean pierre
marie michel sophie claude nicolas juan carlos jose luis carmen pilar antonio francisco isabel""".split()

NAME = rf"(?<![A-Za-z])(?:{'|'.join(n.capitalize() for n in GIVEN_NAMES)})\x20[A-Z][a-z]{{2,20}}(?![A-Za-z])"

PATTERNS = {
    "email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE,
    "secret": SECRET, "local_phone": LOCAL_PHONE, "iban": IBAN, "social": SOCIAL, "name": NAME,
}

#: A text can hold a kind only if it matches this.
GATES = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
    "secret": r"[A-Za-z0-9_]\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.-]{8}", "local_phone": r"[0-9]\)?[\x20./-][0-9]", "iban": "[A-Z]{2}[0-9]{2}",
    "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "name": rf"(?:{'|'.join(n.capitalize() for n in GIVEN_NAMES)})\x20[A-Z]",
}

GAZETTEERS = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|ch|at|eu|us|ca|mx|ar)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-46-9]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(?:[a-z0-9]+_)*(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|apikey|auth|credential|private_?key)[0-9]*\x20?[=:]",
    "local_phone": r"^\(?0",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "social": r"^(?!000|666|9)",
    "name": r"^(?!.* (?:Street|Avenue|City|Park|Day|University)$)",
}

CUES = {
    "email": r"e-?mail|mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|from|adresse",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel|mobile|fax|contact|ring|telefon|anruf",
    "secret": r"login|user|key|credential|config|env|account",
    "local_phone": r"phone|call|tel|mobile|fax|contact|ring|telefon|anruf",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "social": r"ssn|social|security|tax",
    "name": r"\b(?:mr|mrs|ms|dr|name|dear|by|herr|frau|madame|monsieur|se[nñ]ora?)\b",
}

#: Said before or after a span, these speak against it.
COUNTER_CUES = r"(?i)version|isbn|page|chapter|figure|[$€%#]\s*$|https?:/"

CONTEXT = 24

VOTES = 6

CANDIDATE = "struct<kind:string,start:bigint,end:bigint,votes:string,values:array<int>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    def weighed(c, i):
        twice = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), weighed)
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """The conditions that a match of a base kind must meet."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    size = F.length(digits(found))
    if kind == "card":
        return F.when((size >= 12) & (size <= 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return (size >= 9) & (size <= 15)
    return F.lit(True)


def iban_checks(found: Column) -> Column:
    """Whether the check digits of an account number are right: moved to the end, letters as 10 to 35, it leaves 1 modulo 97."""
    bare = F.regexp_replace(found, "\\x20", "")
    signs = F.split(F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4))), "(?<=.)(?=.)")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(signs, F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _vote(favour: Column, against: Column) -> Column:
    return F.when(favour, "+").when(against, "-").otherwise("0")


def votes(kind: str, m: Column) -> Column:
    """One sign per labeler: pattern, characters, gazetteer, cue before, counter-cue, edges."""
    found, before, after = m["found"], F.right(m["before"], F.lit(CONTEXT)), F.left(m["after"], F.lit(CONTEXT))
    pattern = valid(kind, found) if kind in BASE_KINDS else F.lit(True)
    if kind == "secret":
        pattern = F.regexp_extract(found, "[=:](.*)", 1).rlike("[0-9]")
    if kind == "iban":
        pattern = iban_checks(found)
    varied = F.size(F.array_distinct(F.split(found, "(?<=.)(?=.)"))) >= 5
    listed = found.rlike(GAZETTEERS[kind])
    cue = before.rlike(f"(?i)(?:{CUES[kind]})[^a-zA-Z]{{0,12}}$|(?:{CUES[kind]})\\W+\\w+\\W*$")
    counter = before.rlike(COUNTER_CUES)
    free = ~before.rlike(r"[A-Za-z0-9]$") & ~after.rlike(r"^[A-Za-z0-9]")
    never = F.lit(False)
    return F.concat(
        _vote(pattern, ~pattern), _vote(varied, ~varied), _vote(listed, ~listed), _vote(cue, never),
        _vote(never, counter), _vote(free, ~free),
    )


def features(kind: str, m: Column) -> Column:
    """Values from 0 to 4: length, share of digits, the character on either side, kinds of characters, and whether the gazetteer has it."""
    found = m["found"]
    size = F.length(found)
    share = F.length(digits(found)) / size

    def side(c):
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike("[.,;:!?]"), 3).otherwise(4)

    kinds = sum((F.when(found.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    return F.array(
        F.when(size < 10, 0).when(size < 14, 1).when(size < 20, 2).when(size < 32, 3).otherwise(4),
        F.floor(F.least(share, F.lit(0.99)) * 5).cast("int"),
        side(F.right(m["before"], F.lit(1))),
        side(F.left(m["after"], F.lit(1))),
        kinds,
        F.when(found.rlike(GAZETTEERS[kind]), 1).otherwise(0),
    )


def spot(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text, with base (valid base spans) and candidates (all matches, judged by the labelers)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "base", "candidates")]
    body = F.coalesce(F.col(text), F.lit(""))
    nothing = located(F.lit(""), F.lit("$^x"))
    column = {kind: marker(docs, f"_{kind}") for kind in PATTERNS}
    matches = docs.select(
        *rest,
        *[
            F.when(body.rlike(GATES[kind]), located(body, F.lit(pattern))).otherwise(nothing).alias(column[kind])
            for kind, pattern in PATTERNS.items()
        ],
    )
    span = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    passed = lambda kind: lambda m: valid(kind, m["found"])
    base = [F.transform(F.filter(F.col(column[kind]), passed(kind)), span(kind)) for kind in BASE_KINDS]

    def judged(kind):
        return F.transform(
            F.col(column[kind]),
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                votes(kind, m).alias("votes"), features(kind, m).alias("values"),
            ),
        )

    candidates = F.concat(*[judged(kind) for kind in PATTERNS])
    return matches.select(*rest, F.concat(*base).alias("base"), candidates.alias("candidates"))


def estimate(counts: dict[tuple[str, str], int], rounds: int = 40) -> dict[tuple[str, str], float]:
    """Expectation-maximisation: for each kind and vote pattern how likely it is personal data."""
    likely = {}
    for kind in sorted({k for k, _ in counts}):
        patterns = {v: n for (k, v), n in counts.items() if k == kind}
        weight = {v: 1 / (1 + math.exp(-(v.count("+") - 2 * v.count("-")))) for v in patterns}
        for _ in range(rounds):
            total = math.fsum(patterns.values())
            mine = math.fsum(weight[v] * n for v, n in patterns.items())
            prior = (mine + 1) / (total + 2)
            share = {}
            for place in range(VOTES):
                for sign in "+-0":
                    with_sign = [(weight[v], n) for v, n in patterns.items() if v[place] == sign]
                    true = math.fsum(w * n for w, n in with_sign)
                    false = math.fsum((1 - w) * n for w, n in with_sign)
                    # A labeler is taken to be better than chance: a few votes of that kind are presumed.
                    presumed = {"+": (4, 1), "-": (1, 4), "0": (2, 2)}[sign]
                    share[place, sign] = (true + presumed[0]) / (mine + 7), (false + presumed[1]) / (total - mine + 7)
            for v in patterns:
                odds = math.log(prior / (1 - prior))
                odds += math.fsum(math.log(share[p, s][0] / share[p, s][1]) for p, s in enumerate(v))
                weight[v] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        likely |= {(kind, v): weight[v] for v in patterns}
    return likely


def train(candidates: DataFrame) -> dict[str, float]:
    """Log-odds of the span classifier by "kind" (its prior) and "kind|feature|value"."""
    counted = (
        candidates.select(F.explode("candidates").alias("c"))
        .select("c.kind", "c.votes", F.posexplode("c.values").alias("feature", "value"))
        .groupBy("kind", "votes", "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    likely = estimate({k: n for k, n in _patterns(counted).items()})
    true, false = defaultdict(list), defaultdict(list)
    for r in counted:
        w = likely[r.kind, r.votes]
        keys = [f"{r.kind}|{r.feature}|{r.value}", *([r.kind] if r.feature == 0 else [])]
        for key in keys:
            true[key].append(w * r.n)
            false[key].append((1 - w) * r.n)
    odds = {}
    for key in sorted(true):
        kind = key.split("|")[0]
        yes, no = math.fsum(true[key]) + 1, math.fsum(false[key]) + 1
        if key == kind:
            odds[key] = math.log(yes / no)
        else:
            odds[key] = math.log(yes / (math.fsum(true[kind]) + 5)) - math.log(no / (math.fsum(false[kind]) + 5))
    return odds


def _patterns(counted) -> dict[tuple[str, str], int]:
    totals: dict[tuple[str, str], int] = defaultdict(int)
    for r in counted:
        if r.feature == 0:
            totals[r.kind, r.votes] += r.n
    return totals


def find_pii(docs: DataFrame, text: str = "text", accept: float = 0.5) -> DataFrame:
    """``docs`` without the text, with base and spans: arrays of struct<kind, start, end>, in order.

    ``base`` are the base spans; ``spans`` also the candidates of further kinds that the trained classifier gives at
    least ``accept`` and that do not overlap a base span. Places count code points, the end is exclusive. Spans
    are ordered by start, then by kind: email, ip, card, phone, then the others by name.

    * Null and empty texts have no spans; without any text, nothing is trained and nothing found.
    * Repeated rows are judged each for itself, and count as often in training.
    * Columns named base, spans or candidates are replaced; others stay.
    """
    spotted = stored(spot(docs.drop("spans"), text), "candidates")
    odds = train(spotted)
    table = F.create_map(*[F.lit(x) for item in odds.items() for x in item]) if odds else None
    base, candidates = F.col("base"), F.col("candidates")

    def score(c):
        keys = F.transform(c["values"], lambda v, i: F.concat_ws("|", c["kind"], i.cast("string"), v.cast("string")))
        terms = F.transform(F.concat(F.array(c["kind"]), keys), lambda k: F.coalesce(F.try_element_at(table, k), F.lit(0.0)))
        return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))

    def added(c):
        apart = ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return ~c["kind"].isin(*BASE_KINDS) & apart & (score(c) >= accept)

    extra = F.transform(F.filter(candidates, added), lambda c: F.struct(*(c[n].alias(n) for n in ("kind", "start", "end")))) if odds else None
    spans = F.concat(base, extra) if odds else base
    return spotted.withColumn("spans", in_order(spans)).withColumn("base", in_order(base)).drop("candidates")


def in_order(spans: Column) -> Column:
    rank = lambda s: F.coalesce(F.array_position(F.lit(list(BASE_KINDS)), s["kind"]).cast("long"), F.lit(0))
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.when(rank(s) == 0, 9).otherwise(rank(s)).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")
        ),
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
