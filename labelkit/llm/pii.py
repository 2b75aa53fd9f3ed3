"""Personal data in texts: strict patterns, and looser candidates judged by weak supervision.

Strict kinds (email, ip, card, phone) are patterns with a check.  Looser candidates (numbers with groups,
handles) are judged by what three kinds of labelers say of them and of the strict spans:

* regex labelers: is the shape one that such data has, or that of a date, a version, a plain count;
* gazetteer labelers: known dialling codes, issuer digits, mail hosts and endings;
* context labelers: words right before the span, since the last one of its kind, that announce such data, or something else.

Each labeler votes for, against or not at all.  Expectation-maximisation over the vote patterns of the
corpus estimates how reliable each labeler is and how likely each pattern is personal data, without
labels.  With these likelihoods as soft labels a naive Bayes classifier over votes, kind, number of
digits and of groups is trained, and decides on each looser candidate.  Strict spans always stay.

Everything that touches rows is DataFrame functions.  The driver sees one aggregate of at most
``6 * 27 * 5 * 3`` rows, whatever the corpus.

Patterns are written so that no text makes them slow: runs are possessive and start only where a run
can start, which changes no match.

Defined results: null text is empty; offsets are code points, end exclusive; without any candidate
nothing is added; repeated documents are scanned one by one; extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkit.functions.binding import let
from labelkit.llm.registry import query
from labelkit.plans.registry import table

STRICT = ("email", "ip", "card", "phone")
LOOSE = ("number", "handle")
KINDS = STRICT + LOOSE
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # a run of local characters is tried at its start, or where the match before ended inside it
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.-])[0-9(](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
    "handle": r"(?<![A-Za-z0-9_.%+@-])@[A-Za-z0-9_]{3,40}(?![A-Za-z0-9_@.])",
}
GUARD = {"email": "@", "handle": "@", "phone": "+", "ip": ".", "card": None, "number": None}
BLOCK = 256
CONTEXT_CHARS = 24
ACCEPT = 0.9
ROUNDS = 30
FOR, AGAINST = 1, -1


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of the matches, from the pieces between them; ``before`` ends the piece.

    Lengths are summed in blocks, so that the work is linear but for a small factor however many there are.
    """

    def body(x: Column) -> Column:
        n = F.size(x.found)
        steps = F.transform(x.found, lambda m, i: F.struct(F.length(F.get(x.pieces, i)).alias("gap"), F.length(m).alias("size"), m.alias("value"), F.substring(F.get(x.pieces, i), -CONTEXT_CHARS, CONTEXT_CHARS).alias("before")))

        def in_blocks(steps: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(BLOCK)).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))

            def summed(blocks: Column) -> Column:
                total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, y: s + y.gap + y.size))
                bases = F.aggregate(
                    total, F.array(F.lit(0)), lambda s, y: F.concat(s, F.array(F.element_at(s, -1) + y))
                )

                def placed(bases: Column) -> Column:
                    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
                    row = lambda at, y: F.struct((at + y.gap).alias("start"), (at + y.gap + y.size).alias("end"), y.value.alias("value"), y.before.alias("before"))
                    return F.flatten(F.transform(blocks, lambda b, k: F.aggregate(
                        b, F.struct(F.get(bases, k).alias("at"), empty.alias("out")),
                        lambda s, y: F.struct((s.at + y.gap + y.size).alias("at"), F.concat(s.out, F.array(row(s.at, y))).alias("out")),
                        lambda s: s.out,
                    )))

                return let(bases, placed)

            return let(blocks, summed)

        return F.when(n == 0, F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")).otherwise(let(steps, in_blocks))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(F.split(text, pattern).alias("pieces"), found.alias("found")), body)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)

        def add(s: Column, i: Column) -> Column:
            digit = F.ascii(F.substring(d, n - i + 1, F.lit(1))) - 48
            double = digit * 2
            return s + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add, lambda s: s % 10 == 0)

    return let(digits, total)


def _valid(kind: str, value: Column) -> Column:
    """The check of a strict kind."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    guard = F.contains(text, F.lit(GUARD[kind])) if GUARD[kind] else text.rlike("[0-9]" if kind == "card" else "[0-9][^A-Za-z]{0,14}[0-9]")
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return F.when(guard, F.filter(_places(text, PATTERNS[kind]), lambda s: _valid(kind, s.value))).otherwise(empty)


def with_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, email, ip, card, phone, number, handle): the last two without those that touch a strict span."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("key", "text", *[_spans(F.col("text"), k).alias(k) for k in KINDS])
    strict = F.concat(*[F.col(k) for k in STRICT])
    apart = lambda k: let(strict, lambda x: F.filter(k, lambda s: ~F.exists(x, lambda t: (s.start < t.end) & (t.start < s.end))))
    return rows.select("key", *STRICT, *[F.when(F.size(k) > 0, apart(F.col(k))).otherwise(F.col(k)).alias(k) for k in LOOSE])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, FOR).when(no, AGAINST).otherwise(0)


ANNOUNCES = r"(?i)(tel|phone|call|fax|mobile|mobil|cell|mail|contact|ssn|card|karte|carte|account|iban|konto|user|ip|addr(ess)?|numéro|número|nummer)\W{0,4}$"
DENIES = r"(?i)(page|seite|isbn|version|v|year|jahr|année|año|figure|total|price|\$|€|£|%|no|nr|id|order|chapter|section)\W{0,3}$"
HOSTS = r"(?i)(gmail|yahoo|hotmail|outlook|icloud|example|mail|proton|gmx|web)[A-Za-z0-9-]*\."
ENDINGS = r"(?i)\.(com|org|net|edu|gov|de|fr|es|uk|io|info|eu)$"
DIALLING = r"^(1|33|34|44|49|39|41|43|31|32|351|48|7|81|86|91|55|52|61|0)"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
PERSONAL_SHAPES = r"^\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,4}([ .-][0-9]{2,4})?$"
OTHER_SHAPES = r"^([0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2,4}|(19|20)[0-9]{2}[ .-].*|[0-9]+)$"


def _labelled(kind: str) -> Column:
    """The candidates of a kind with votes and features."""

    def one(s: Column) -> Column:
        digits = _digits(s.value)
        if kind == "email":
            shape, known = F.lit(FOR), _vote(s.value.rlike(HOSTS) | s.value.rlike(ENDINGS), F.lit(False))
        elif kind == "handle":
            shape, known = _vote(s.value.rlike("[a-z][0-9_]|[0-9_][a-z]"), s.value.rlike("^@[0-9]+$")), F.lit(0)
        else:
            shape = _vote(s.value.rlike(PERSONAL_SHAPES), s.value.rlike(OTHER_SHAPES)) if kind == "number" else F.lit(FOR)
            table_ = {"card": ISSUERS, "phone": DIALLING, "number": DIALLING}.get(kind)
            known = _vote(digits.rlike(table_), ~digits.rlike(table_)) if table_ else _vote(s.value.rlike(r"^(10|172|192)\."), F.lit(False))
        groups = F.size(F.split(s.value, r"[\x20().-]+"))
        return F.struct(
            s.start.alias("start"), s.end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
            shape.cast("int").alias("shape"), known.cast("int").alias("known"), _vote(s.before.rlike(ANNOUNCES), s.before.rlike(DENIES)).cast("int").alias("context"),
            F.least(F.call_function("div", F.length(digits), F.lit(4)), F.lit(4)).cast("int").alias("digits"),
            F.when(groups <= 1, 0).when(groups <= 3, 1).otherwise(2).alias("groups"),
        )

    return F.transform(F.col(kind), one)


FEATURES = {"kind": len(KINDS), "shape": 3, "known": 3, "context": 3, "digits": 5, "groups": 3}
VOTES = ("shape", "known", "context")


def reliabilities(counts: list[dict], rounds: int = ROUNDS) -> list[float]:
    """Posterior of "personal" for each counted pattern, by expectation-maximisation over the votes."""
    share = 0.5
    rate = {y: {v: {FOR: 0.7 if y else 0.2, AGAINST: 0.1 if y else 0.6, 0: 0.2} for v in VOTES} for y in (0, 1)}
    posterior = [0.5] * len(counts)
    for _ in range(rounds):
        for i, row in enumerate(counts):
            like = [(share if y else 1 - share) * math.prod(rate[y][v][row[v]] for v in VOTES) for y in (0, 1)]
            posterior[i] = like[1] / (like[0] + like[1])
        total = sum(r["n"] for r in counts)
        share = min(max(sum(p * r["n"] for p, r in zip(posterior, counts)) / total, 0.01), 0.99)
        for y in (0, 1):
            weight = [(p if y else 1 - p) * r["n"] for p, r in zip(posterior, counts)]
            for v in VOTES:
                for said in (FOR, 0, AGAINST):
                    rate[y][v][said] = (sum(w for w, r in zip(weight, counts) if r[v] == said) + 1) / (sum(weight) + 3)
    return posterior


def classifier(counts: list[dict]) -> dict[str, list[float]]:
    """Log odds per feature value, and ``prior``: naive Bayes on the soft labels."""
    if not counts:
        return {}
    soft = reliabilities(counts)
    mass = [sum((p if y else 1 - p) * r["n"] for p, r in zip(soft, counts)) + 1 for y in (0, 1)]
    odds = {"prior": [math.log(mass[1] / mass[0])]}
    for name, size in FEATURES.items():
        shift = 1 if name in VOTES else 0
        odds[name] = []
        for value in range(size):
            part = [sum((p if y else 1 - p) * r["n"] for p, r in zip(soft, counts) if r[name] + shift == value) + 1 for y in (0, 1)]
            odds[name].append(math.log(part[1] / (mass[1] + size)) - math.log(part[0] / (mass[0] + size)))
    return odds


def _accepted(s: Column, odds: dict[str, list[float]]) -> Column:
    total = F.lit(odds["prior"][0])
    for name in FEATURES:
        at = s[name] + (1 if name in VOTES else 0)
        total = total + F.get(F.array(*[F.lit(x) for x in odds[name]]), at)
    return total >= math.log(ACCEPT / (1 - ACCEPT))


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and, per strict kind and for all spans added, arrays of struct<start, end>."""
    spans = with_spans(docs, key, text)
    labelled = spans.select("key", *STRICT, F.concat(*[_labelled(k) for k in KINDS]).alias("candidates"))
    counted = labelled.select(F.inline("candidates")).groupBy(*FEATURES).agg(F.count("*").alias("n"))
    odds = classifier([r.asDict() for r in counted.collect()])  # at most 6 * 27 * 5 * 3 rows
    place = lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))
    loose = F.lit(len(STRICT))
    added = F.filter("candidates", lambda s: (s.kind >= loose) & (_accepted(s, odds) if odds else F.lit(False)))
    return labelled.select("key", *[F.transform(k, place).alias(k) for k in STRICT], added.alias("added")).select(
        "key", *STRICT, *[F.transform(F.filter("added", lambda s: s.kind == KINDS.index(k)), place).alias(k) for k in LOOSE]
    )


def _listed(kinds: tuple[str, ...]) -> Column:
    texts = [F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))) for k in kinds]  # noqa: B023
    return F.array_join(F.concat(*texts), ",")


@query()
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in STRICT],
        F.sha2(_listed(STRICT).cast("binary"), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
    )
