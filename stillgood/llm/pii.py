"""Personal data: exact detectors, and spans that boosted trees add from high-recall candidates.

Everything is a column expression over the text; the trees are Spark's. A loose pattern proposes
spans, the exact detectors label those they confirm, and the trees learn from format and context
which of the others look the same. The threshold is the lowest at which all candidates of the
half that was not learnt from keep the target precision.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns. A run of characters that may begin a match is entered at its start or where
#: the match before ended, which finds the same matches without trying every character of the run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDED = {"email": "@", "ip": ".", "card": "[0-9][\\x20-]?[0-9]", "phone": "+"}
#: Candidates: anything around an at sign, and runs of digits with separators.
LOOSE = r"(?:\G|(?<![^\s<>,;]))[^\s<>,;@]++@[^\s<>,;]+|\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
CONTEXT = {"says_mail": "mail|contact|write", "says_phone": "phone|tel|call|fax", "says_card": "card|visa|iban|account", "says_ip": "ip|host|server|address"}
FORMAT = ("size", "digits", "dots", "dashes", "blanks", "plus", "at", "joined_before", "joined_after")
FEATURES = (*FORMAT, *CONTEXT)
#: Bound of the candidates that the trees learn from.
SAMPLE = 20_000
#: Steps of the threshold.
STEPS = 10_000
#: Matches whose positions are added up together.
BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """The array cut into runs of ``BLOCK``; one empty run if it is empty."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")))
    return F.transform(at, lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _running(steps: Column, zero: Column, add: Callable[[Column, Column], Column], of: str) -> Column:
    """What ``add`` makes of all steps before each one; the array grows once per step, so keep it short."""
    start = F.struct(zero.alias("at"), F.array().cast(f"array<{of}>").alias("out"))
    grow = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(steps, start, grow, lambda s: s["out"])


def _spans(text: Column, pattern: str) -> Column:
    """Matches as array of (start, end, value, before, after), positions in code points, end exclusive.

    Splitting at the matches gives what lies between them; running lengths are the positions. They
    run within blocks, then over the blocks, so many matches of one text are not copied for each.
    """
    matches = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    reach = lambda m: F.length(m["before"]) + F.length(m["value"])
    total = lambda block: F.aggregate(block, F.lit(0), lambda n, m: n + reach(m))

    def placed(block: Column, offset: Column) -> Column:
        def one(m: Column, at: Column) -> Column:
            start = offset + at + F.length(m["before"])
            return F.struct(
                start.alias("start"), (start + F.length(m["value"])).alias("end"), m["value"].alias("value"),
                F.lower(F.right(m["before"], F.lit(16))).alias("before"), F.left(m["after"], F.lit(1)).alias("after"))

        return _let(_running(block, F.lit(0), lambda n, m: n + reach(m), "int"), lambda ats: F.zip_with(block, ats, one))

    def whole(blocks: Column) -> Column:
        offsets = _running(F.transform(blocks, total), F.lit(0), lambda n, size: n + size, "int")
        return F.flatten(F.zip_with(blocks, offsets, placed))

    def zipped(found: Column) -> Column:
        parts = lambda gaps: F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("before"), F.slice(gaps, 2, F.size(found)).alias("after"))
        return _let(_let(F.split(text, pattern, -1), parts), lambda z: _let(_blocks(z), whole))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) > 0, zipped(f)).otherwise(F.array().cast(matches)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2)
    return F.aggregate(at, F.lit(0), lambda s, i: s + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.concat(F.lit("0"), F.left(part(x), F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return F.when(size.between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(8, 15)
    return F.lit(True)


def exact_spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end) of the matches that pass the kind's test; empty for null texts."""
    needed = NEEDED[kind]
    tried = text.rlike(needed) if len(needed) > 1 else text.contains(needed)
    spans = F.filter(_spans(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))
    plain = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(tried, plain).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))


def candidates(text: Column, exact: Column) -> Column:
    """Proposed spans with their features and whether an exact span overlaps them (label)."""
    count = lambda v, chars: F.length(v) - F.length(F.translate(v, chars, ""))

    def one(s: Column) -> Column:
        v = s["value"]
        columns = {
            "size": F.length(v), "digits": F.length(_digits(v)), "dots": count(v, "."), "dashes": count(v, "-"), "blanks": count(v, " "),
            "plus": count(v, "+"), "at": count(v, "@"), "joined_before": s["before"].rlike(r"[\p{L}\p{N}]$").cast("int"), "joined_after": s["after"].rlike(r"[\p{L}\p{N}]").cast("int"),
        } | {name: s["before"].rlike(words).cast("int") for name, words in CONTEXT.items()}
        label = F.exists(exact, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).cast("int")
        kind = (
            F.when(columns["at"] > 0, "email").when(columns["plus"] > 0, "phone").when((columns["dots"] == 3) & (columns["digits"] <= 12), "ip")
            .when(columns["digits"].between(16, 19), "card").otherwise("phone")
        )
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), label.alias("label"), *(c.cast("double").alias(n) for n, c in columns.items()))

    tried = text.rlike("@|[0-9]")
    return F.when(tried, F.transform(_spans(text, LOOSE), one))


def _step(probability: Column) -> Column:
    return F.floor(vector_to_array(probability)[1] * STEPS)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train(found: DataFrame, precision: float = 0.99, rounds: int = 10, depth: int = 3) -> tuple[GBTClassificationModel, int] | None:
    """Trees on at most ``SAMPLE`` candidates of one half by hash, threshold on all of the other half.

    The threshold is the lowest step of 1 / ``STEPS`` from which on the other half keeps the precision;
    above all steps if none does. None if the sample lacks a label. The sample is cut by hash before it is sorted.
    """
    order = F.xxhash64("key", "c.start")
    rows = found.select("key", F.explode("candidates").alias("c")).select(order.alias("order"), "key", "c.*")
    mine = rows.where("order % 2 = 0")
    share = min(1.0, 2.0 * SAMPLE / max(1, mine.count()))
    drawn = mine.where(F.pmod("order", F.lit(1 << 40)) <= share * (1 << 40)).orderBy("order", "key", "start").limit(SAMPLE)
    sample = written(drawn.select(F.col("label").cast("double").alias("label"), *FEATURES), "sample")
    if sample.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7).fit(_assembled(sample).coalesce(1))
    scored = model.transform(_assembled(rows.where("order % 2 <> 0")))
    curve = scored.groupBy(_step(F.col("probability")).alias("step")).agg(F.count("*").alias("n"), F.sum("label").alias("right")).collect()
    best, n, right = STEPS + 1, 0, 0
    for mark in sorted(curve, key=lambda r: -r.step):
        n, right = n + mark.n, right + mark.right
        if right >= precision * n:
            best = mark.step
    return model, best


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False, precision: float = 0.99) -> DataFrame:
    """``(id, exact, spans[, row])`` per row of ``docs``: the exact spans, and these with the added ones.

    Both are ordered by kind (as in ``KINDS``), then start. Added spans never overlap exact ones, so
    those stay. Null and empty texts have none; repeated rows and null ids get a row each; without
    confirmed and rejected candidates nothing is added; an empty table gives no rows. ``keep`` adds
    the whole row, whatever its columns, as ``row``.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), value.alias("body"), *([F.struct("*").alias("row")] if keep else []))
    rows = rows.withColumn("exact", reduce(F.concat, (exact_spans(F.col("body"), k) for k in KINDS)))
    rows = rows.withColumn("candidates", candidates(F.col("body"), F.col("exact"))).drop("body").withColumn("key", F.monotonically_increasing_id())
    found = written(rows, "pii")
    trained = train(found, precision)
    span = "struct<kind:string,start:int,end:int>"
    if trained is None:
        return found.withColumn("spans", F.col("exact")).drop("key", "candidates")
    model, threshold = trained
    open_ones = found.select("key", F.explode("candidates").alias("c")).where("c.label = 0").select("key", "c.*")
    scored = model.transform(_assembled(open_ones))
    added = written(
        scored.where(_step(F.col("probability")) >= threshold).groupBy("key")
        .agg(F.collect_list(F.struct("kind", "start", "end").cast(span)).alias("added")), "added")
    together = F.concat("exact", F.coalesce("added", F.array().cast(f"array<{span}>")))
    by_kind = reduce(F.concat, (F.array_sort(of_kind(together, k), lambda a, b: a["start"] - b["start"]) for k in KINDS))
    return found.join(broadcast_if_small(added), "key", "left").withColumn("spans", by_kind).drop("key", "candidates", "added")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """Text with every span (overlapping ones together) replaced by the name of its kind in brackets.

    Null texts stay null; a text without spans stays as it is. The text is cut into blocks of spans first,
    so that finding a span's place does not mean walking a long text from its beginning.
    """
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    last = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))

    def masked(block: Column, begin: Column) -> Column:
        """From where the blocks before end (``begin``) to where this one ends."""
        here = F.substring(text, begin + 1, F.greatest(begin, last(block)) - begin)

        def piece(part: Column, s: Column, at: Column) -> Column:
            between = F.substring(part, at - begin + 1, s["start"] - at)
            return F.when(s["start"] >= at, F.concat(between, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        before = _running(block, begin, lambda at, s: F.greatest(at, s["end"]), "int")
        return _let(here, lambda part: _let(before, lambda ats: F.array_join(F.zip_with(block, ats, lambda s, at: piece(part, s, at)), "")))

    def whole(blocks: Column) -> Column:
        begins = _running(F.transform(blocks, last), F.lit(0), lambda at, end: F.greatest(at, end), "int")
        rest = F.substring(text, F.array_max(F.transform(blocks, last)) + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(blocks, begins, masked), ""), rest)

    return F.when(F.size(spans) > 0, _let(ordered, lambda o: _let(_blocks(o), whole))).otherwise(text)
