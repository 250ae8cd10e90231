"""Personal data by weak supervision, in DataFrame operations.

Patterns propose candidate spans: the four base kinds, and weaker kinds (local phone numbers, social security
numbers, names of two words, long keys and tokens).  Three labelers vote on every candidate or abstain: a regex labeler on its exact
shape, a gazetteer labeler on what it holds (first names, card issuers, reserved networks, top-level domains) and
a context labeler on the cue words before it.  The vote patterns of all candidates, counted in Spark, train a
label model by expectation-maximisation; its posteriors train the final classifier, a logistic regression over
kind and votes, whose score decides on every candidate.  Base spans are kept whatever the classifier says, and
give way to nothing; an added span may not overlap a base span.

Matching is linear in the text: no pattern nests repetitions or can start twice in one run of characters.

Edge cases: a null or empty text has no spans; repeated rows, also of one doc_id, are judged each by their own
text; an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.llm import label_model, workspace

CONTEXT_CHARS = 40
LEAST_SCORE = 0.5

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A kind of span: a cheap test of the text, the pattern, and cue words that speak for or against it."""

    name: str
    test: str
    pattern: str
    cues: str
    counter_cues: str = "(?!)"


#: The base kinds, fixed by the contract (each pattern finds what the contract's does, in linear time), in its order.
BASE = (
    Kind(
        "email",
        "@[A-Za-z0-9-]",
        # a run of local characters is tried from its start or from the last match's end only; the domain runs on to
        # the first place where a dot has no label after it
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
        r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
        r"(?i)\b(?:git|ssh|scp)\b",
    ),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"(?i)\b(?:ip|host|server|address|from|login)\b", r"(?i)\b(?:version|section|release|chapter|v)\b"),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9]){13}",
        # digits with single separators between them, up to the first place where that ends
        r"(?<![0-9])(?<![0-9][ -])[0-9][0-9 -]*?(?<=[0-9])(?=[^0-9 -]|[ -](?![0-9])|\z)",
        r"(?i)\b(?:card|visa|mastercard|credit|debit|tarjeta|carte|karte)\b",
        r"(?i)\b(?:isbn|order|invoice|serial|tracking|sku)\b",
    ),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|tel[eé]fono)\b", r"(?i)\b(?:gmt|utc)\b"),
)
#: Kinds that the method adds.
WEAK = (
    Kind(
        "local_phone",
        r"[0-9]{3}[ .-][0-9]{4}",
        r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
        r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|tel[eé]fono)\b",
        r"(?i)\b(?:isbn|order|invoice|serial|part|no)\b",
    ),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"(?i)\b(?:ssn|social security)\b", r"(?i)\b(?:part|order|sku|model)\b"),
    Kind(
        "name",
        # what every match holds, so that a name without a title is proposed as well
        r"(?<![A-Za-z])[A-Z][a-z]{1,20} [A-Z][a-z]",
        r"(?<![A-Za-z])[A-Z][a-z]{1,20} [A-Z][a-z]{1,30}(?![A-Za-z])",
        r"(?:\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra)\.? |(?i:my name is|i am|signed|by|born) )\z",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32}",
        # a long run with a digit in it, looked for from its start only
        r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{32,}+",
        r"(?i)\b(?:token|secret|password|passwd|passphrase|api[ _-]?key|access[ _-]?key|auth|bearer)\b",
        r"(?i)\b(?:sha1|sha256|md5|commit|checksum|digest|uuid|etag)\b",
    ),
)
KINDS = (*BASE, *WEAK)

#: Gazetteers: fixed values.
FIRST_NAMES = "James|Mary|Robert|Patricia|John|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Anna|Maria|Peter|Hans|Ursula|Klaus|Jean|Marie|Pierre|Carmen|Jose|Juan|Antonio|Lucia"
TOP_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|us|ca"
CARD_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
KEY_BEGINNINGS = "AKIA|ASIA|ghp_|gho_|sk_live_|sk_test_|xox[abp]-|eyJ"
RESERVED_NETWORKS = r"0+\.|127\.|10\.|192\.168\.|255\."

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass the Luhn check."""
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).otherwise((2 * value(i)) % 10 + F.floor(2 * value(i) / 10).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda total, i: total + doubled(i)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """The base checks; kinds that the method adds are never base spans."""
    digits = _digits(match)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def _proposed(kind: Kind) -> Column:
    """The matches of a kind in ``text`` with the characters between them, an empty list where the test fails."""
    matches = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
    # the pieces between matches, of which the last has no match after it
    before = F.slice(F.split("text", kind.pattern), F.lit(1), F.size(matches))
    found = F.transform(
        F.arrays_zip(before.alias("gap"), matches.alias("match")),
        lambda x: F.struct(F.lit(kind.name).alias("kind"), F.length(x["gap"]).alias("gap"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"), x["match"].alias("match")),
    )
    return F.when(F.col("text").rlike(kind.test), found)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


_KEY = ["doc_id", "h1", "h2"]


def candidates(texts: DataFrame) -> DataFrame:
    """doc_id, h1, h2, kind, start, end, match, before, base of every proposed span, once for each distinct text."""
    some = texts.filter(F.col("text").rlike("|".join(f"(?:{k.test})" for k in KINDS)))
    empty = F.array().cast("array<struct<kind:string,gap:int,before:string,match:string>>")
    every = F.concat(*(F.coalesce(_proposed(k), empty) for k in KINDS))
    each = some.select(*_KEY, F.posexplode(every).alias("no", "found")).select(*_KEY, "no", "found.*").dropDuplicates([*_KEY, "no"])
    so_far = Window.partitionBy(*_KEY, "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return each.withColumn("end", end).select(*_KEY, "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", _valid(F.col("kind"), F.col("match")).alias("base"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), 0).otherwise(-1)


def _by_kind(choices: dict[str, Column]) -> Column:
    return reduce(lambda out, k: F.when(F.col("kind") == k, choices[k]).otherwise(out), choices, F.lit(-1))


LABELERS = ("regex", "gazetteer", "context")


def votes(found: DataFrame) -> DataFrame:
    """``found`` with one column for each labeler: 1 personal data, 0 not, -1 abstains."""
    match, before, digits = F.col("match"), F.col("before"), _digits(F.col("match"))
    shape = _by_kind(
        {
            **{k.name: _vote(F.col("base"), ~F.col("base")) for k in BASE},
            "local_phone": _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), ~digits.rlike("^[2-9][0-9]{2}[2-9]")),
            "secret": _vote(match.rlike("^(?=[0-9]*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_]+$"), match.rlike("^[0-9_-]+$|^[a-z]+(?:-[a-z0-9]+)+$")),
            "ssn": _vote(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), match.rlike("^(?:000|666|9)|-00-|-0000$")),
        }
    )
    known = _by_kind(
        {
            "email": _vote(match.rlike(rf"(?i)\.(?:{TOP_DOMAINS})$"), match.rlike(r"\.[0-9]+$")),
            "ip": _vote(F.lit(False), match.rlike(f"^(?:{RESERVED_NETWORKS})")),
            "card": _vote(digits.rlike(f"^(?:{CARD_ISSUERS})"), ~digits.rlike(f"^(?:{CARD_ISSUERS})")),
            "phone": _vote(match.rlike(r"^\+[1-9]"), match.rlike(r"^\+0")),
            "name": _vote(match.rlike(f"^(?:{FIRST_NAMES}) "), F.lit(False)),
            "secret": _vote(match.rlike(f"^(?:{KEY_BEGINNINGS})"), F.lit(False)),
        }
    )
    cues = _by_kind({k.name: _vote(before.rlike(k.cues), before.rlike(k.counter_cues)) for k in KINDS})
    return found.withColumns({"vote_regex": shape, "vote_gazetteer": known, "vote_context": cues})


def train(voted: DataFrame) -> label_model.SpanClassifier:
    """Label model and classifier from the counted vote patterns; at most ``kinds * 3 ** labelers`` rows are gathered."""
    names = [f"vote_{k}" for k in LABELERS]
    counted = voted.groupBy("kind", *names).agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[int, ...], int] = {}
    for row in counted:
        key = tuple(row[k] for k in names)
        patterns[key] = patterns.get(key, 0) + row["n"]
    model = label_model.fit(patterns, len(names))
    rows = [(row["kind"], tuple(row[k] for k in names), row["n"]) for row in counted]
    return label_model.fit_classifier([(kind, v, n, model.posterior(v)) for kind, v, n in rows], [k.name for k in KINDS], len(names))


def score(classifier: label_model.SpanClassifier) -> Column:
    """The classifier's probability from ``kind`` and the votes."""
    terms = [F.lit(classifier.bias)]
    terms += [F.when(F.col("kind") == k, F.lit(w)).otherwise(0.0) for k, w in classifier.kinds.items()]
    for name, (no, yes) in zip(LABELERS, classifier.votes, strict=True):
        terms.append(F.when(F.col(f"vote_{name}") == 1, F.lit(yes)).when(F.col(f"vote_{name}") == 0, F.lit(no)).otherwise(0.0))
    return 1 / (1 + F.exp(-reduce(Column.__add__, terms)))


def spans(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, h1, h2, kind, start, end, base, score of every accepted span, once for each distinct text."""
    voted = votes(candidates(_texts(docs)))
    voted = workspace.cut(voted.drop("match", "before"))
    judged = voted.withColumn("score", score(train(voted)))
    # an added span must not touch a base span: the furthest end of base spans so far, in order of start, shows it
    by_start = Window.partitionBy(*_KEY).orderBy("start", "end", "kind")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    backward = Window.partitionBy(*_KEY).orderBy(F.col("start").desc(), F.col("end").desc(), F.col("kind").desc())
    later = F.min(F.when(F.col("base"), F.col("start"))).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end"))
    accepted = judged.withColumn("free", free).filter(F.col("base") | (F.col("free") & (F.col("score") >= least_score)))
    return accepted.drop("free", *(f"vote_{k}" for k in LABELERS))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans of every row."""
    order = F.array_position(F.array(*(F.lit(k.name) for k in KINDS)), F.col("kind"))
    listed = spans(docs).select(*_KEY, "base", "kind", F.struct("start", order.alias("rank"), "end", "kind").alias("span"))
    text_of = lambda items: F.array_join(F.transform(F.array_sort(items), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k.name)).alias(f"n_{k.name}") for k in BASE]
    found = listed.groupBy(*_KEY).agg(*counts, F.count("*").alias("n_spans"), text_of(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base_spans"), text_of(F.collect_list("span")).alias("spans"))
    rows = _texts(docs).select(*_KEY).alias("d")
    both = rows.join(found.alias("f"), [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in _KEY], "left")
    return both.select(
        "d.doc_id",
        *(F.coalesce(f"n_{k.name}", F.lit(0)).cast("long").alias(f"n_{k.name}") for k in BASE),
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
