"""Personal data by rules and by boosted trees over wide candidate patterns.

Base spans follow fixed patterns and checks and always stay.  Beside them,
wide generators propose overlapping candidates (obfuscated addresses, numbers
in other notations); gradient-boosted trees score each from its format and its
context, and a threshold for each kind, calibrated on held-out examples, picks
the spans that are added.  A candidate that overlaps a base span adds nothing,
and of overlapping candidates the likeliest stays.

The trees are trained on examples that templates generate (a fixed, documented
number of rows); no document is needed for it.

Everything runs as DataFrame expressions.  Positions are code points, the end
exclusive.  They come from marking the matches in the text with a private
separator and adding up the lengths of the parts; a separator that stands in
the text is first turned into another character that no pattern matches.

Null text is empty: no spans, counts of 0.  Repeated rows are judged one by one
and each keeps its row.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_MARK, _OTHER = "\u0001", "\u0002"

#: Patterns of the base spans (fixed values, written without backtracking) and a cheap test that a text may hold one.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", None),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}

#: Wide generators of candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\)|\[dot\])\x20?[0-9]{1,3}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){12,18}+",
    "phone": r"(?<![0-9])\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){8,13}+",
}

#: Words before a span that speak for personal data.
CUES = r"(?i)\b(?:tel|phone|mobile|call|fax|card|visa|pay|mail|contact|ip|host|server|address)\b"

_FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "length", "digits", "letters", "marks", "groups", "longest", "first", "luhn", "small_parts", "disguised", "cue", "joined_before", "joined_after", "bracket")


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, span>> of the leftmost non-overlapping matches in a cleaned text."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,span:string>>").alias("spans"), F.lit(False).alias("inside"))

    def step(state: Column, part: Column) -> Column:
        to = state["at"] + F.length(part)
        one = F.array(F.struct(state["at"].alias("start"), to.alias("end"), part.alias("span")))
        return F.struct(to.alias("at"), F.when(state["inside"], F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"), (~state["inside"]).alias("inside"))

    return F.aggregate(parts, start, step, lambda state: state["spans"])


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _small(part: Column) -> Column:
    """Whether a run of digits is at most 255, however many zeros lead it."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def valid(kind: str, span: Column) -> Column:
    digits = _digits(span)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), _small)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of all base spans of a cleaned text, by start and then kind."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def of(rank: int, kind: str) -> Column:
        pattern, needs = BASE[kind]
        may = F.contains(text, F.lit(needs)) if needs else F.rlike(text, F.lit("[0-9]"))
        kept = F.filter(found(text, pattern), lambda m: valid(kind, m["span"]))
        shaped = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
        return F.when(may, shaped).otherwise(empty)

    each = [of(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_features(rows: DataFrame) -> DataFrame:
    """Format and context features of rows with kind, span, before and after."""
    span, digits = F.col("span"), _digits(F.col("span"))
    groups = F.filter(F.split(span, "[^0-9]+"), lambda g: F.length(g) > 0)
    flag = lambda c: c.cast("double")
    number = lambda c: c.cast("double")
    return rows.withColumns(
        {f"is_{k}": flag(F.col("kind") == k) for k in KINDS}
        | {
            "length": number(F.length(span)),
            "digits": number(F.length(digits)),
            "letters": number(F.length(F.regexp_replace(span, "[^A-Za-z]", ""))),
            "marks": number(F.length(F.regexp_replace(span, r"[A-Za-z0-9]", ""))),
            "groups": number(F.size(groups)),
            "longest": number(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))),
            "first": number(F.coalesce(F.length(F.get(groups, 0)), F.lit(0))),
            "luhn": flag(F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))),
            "small_parts": flag(F.forall(groups, _small)),
            "disguised": flag(F.rlike(span, F.lit(r"\((?:at|dot|\.)\)|\[(?:at|dot|\.)\]|\{(?:at|dot)\}"))),
            "cue": flag(F.rlike(F.col("before"), F.lit(CUES))),
            "joined_before": flag(F.rlike(F.col("before"), F.lit(r"[A-Za-z0-9+$#=._/-]$"))),
            "joined_after": flag(F.rlike(F.col("after"), F.lit(r"^[A-Za-z0-9%=_/-]"))),
            "bracket": flag(F.startswith(span, F.lit("("))),
        }
    )


#: Example templates: kind, label, text; # is a random digit, ~ a random letter, * the digit that makes the number pass Luhn (last) or fail it (!).
TEMPLATES = [
    ("email", 1, "~~~~~ [at] ~~~~~~ [dot] com"), ("email", 1, "~~~.~~~~(at)~~~~~~.org"), ("email", 1, "~~~~## {at} ~~~~~ {dot} net"), ("email", 1, "~~~~[at]~~~~.example.com"),
    ("email", 0, "~~~~ at ~~~~~~.~~~~"), ("email", 0, "~~ at ~~~~. ~~~"), ("email", 0, "~~~~~ at ~~~ dot ~~~~~~"), ("email", 0, "~ @ ~~~.~~"), ("email", 0, "~~~~@~~~~. ~~~~"),
    ("ip", 1, "1##[.]1#.##[.]#"), ("ip", 1, "1#[.]##[.]#[.]1##"), ("ip", 1, "1##(.)1##(.)#(.)1#"), ("ip", 1, "##[dot]1#[dot]1##[dot]#"),
    ("ip", 0, "#. #. #. #"), ("ip", 0, "##. ##. ##. ##"), ("ip", 0, "4##.5##.6##.7##"), ("ip", 0, "# . # . # . #"), ("ip", 0, "9##[.]8##[.]7##[.]5##"),
    ("card", 1, "4###.####.####.###*"), ("card", 1, "5###/####/####/###*"), ("card", 1, "4###_####_####_###*"), ("card", 1, "3### - ###### - ####*"), ("card", 1, "6### . #### . #### . ###*"),
    ("card", 0, "4###.####.####.###!"), ("card", 0, "################!"), ("card", 0, "5###/####/####/###!"), ("card", 0, "20##-0#-1# 1#.#####!"), ("card", 0, "#.#############!"), ("card", 0, "#### - ###### - ####!"),
    ("phone", 1, "(2##) 5##-####"), ("phone", 1, "(8##) ###-####"), ("phone", 1, "2##-5##-####"), ("phone", 1, "0## #### ####"), ("phone", 1, "00## ### ### ####"), ("phone", 1, "9##.5##.####"),
    ("phone", 0, "##########"), ("phone", 0, "##############"), ("phone", 0, "20##-0#-1# ##"), ("phone", 0, "20##/0#/1#-####"), ("phone", 0, "#.#########"), ("phone", 0, "#.#.#.#.#.#.#.#.#.#"), ("phone", 0, "1##.##.1##.##"), ("phone", 0, "## ## ## ## ##"),
]


def examples(spark: SparkSession, rows: int = 4200) -> DataFrame:
    """Labelled spans with context, made from the templates; the same rows each time."""
    made = spark.range(rows).withColumn("t", F.get(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(y)).alias("label"), F.lit(t).alias("template")) for k, y, t in TEMPLATES]), (F.col("id") % len(TEMPLATES)).cast("int"))).select("id", "t.*")
    chance = lambda i, n: F.pmod(F.xxhash64(F.col("id"), i), F.lit(n))
    letter = lambda i: F.substring(F.lit("etaoinshrdlucmfwyp"), (chance(i, 18) + 1).cast("int"), F.lit(1))
    filled = F.array_join(F.transform(F.split("template", ""), lambda c, i: F.when(c == "#", chance(i, 10).cast("string")).when(c == "~", letter(i)).otherwise(c)), "")
    made = made.withColumn("filled", filled)
    bare = F.regexp_replace("filled", "[^0-9]", "")
    fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.concat(bare, d.cast("string"))))
    last = F.get(fits, 0)
    span = F.translate(F.translate("filled", "*", "\u0003"), "!", "\u0004")
    span = F.regexp_replace(F.regexp_replace(span, "\u0003", last.cast("string")), "\u0004", F.pmod(last + 3, F.lit(10)).cast("string"))
    cue = F.get(F.array(*[F.lit(x) for x in ("the of and ", "tel: ", "contact ", "is ", "call ", "for the ", "mail ", "\n")]), chance(F.lit(101), 8).cast("int"))
    attached = F.col("label") == 0
    before = F.when(attached & (chance(F.lit(102), 4) == 0), F.get(F.array(*[F.lit(x) for x in ("id=", "x", "$", "no. 7-")]), chance(F.lit(103), 4).cast("int"))).otherwise(cue)
    after = F.when(attached & (chance(F.lit(104), 4) == 0), F.get(F.array(*[F.lit(x) for x in ("7", "%", "a1", "-9")]), chance(F.lit(105), 4).cast("int"))).otherwise(F.get(F.array(*[F.lit(x) for x in (" the", ". Of", "", ", and")]), chance(F.lit(106), 4).cast("int")))
    return with_features(made.select("id", "kind", "label", span.alias("span"), before.alias("before"), after.alias("after")))


def train(spark: SparkSession, rows: int = 4200, trees: int = 8, depth: int = 5, precision: float = 0.98) -> tuple[GBTClassificationModel, dict[str, float]]:
    """The trees, and for each kind the least probability that keeps ``precision`` on held-out examples."""
    made = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(examples(spark, rows)).withColumn("held", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, stepSize=0.3).fit(made.filter("NOT held").select("features", "label").coalesce(1))
    held = _scored(model, made.filter("held")).select("kind", "label", F.floor(F.col("probability") * 100).alias("score"))
    right = held.groupBy("kind", "score").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()
    limits = {}
    for kind in KINDS:
        own = [r for r in right if r["kind"] == kind]
        fits = [t for t in range(50, 100) if (n := sum(r["n"] for r in own if r["score"] >= t)) and sum(r["hits"] for r in own if r["score"] >= t) >= precision * n]
        limits[kind] = min(fits, default=200) / 100
    return model, limits


def _scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    kept = rows.columns
    return model.transform(rows).withColumn("chance", vector_to_array("probability")[1]).select(*[c for c in kept if c != "features"], F.col("chance").alias("probability"))


def _candidates(rows: DataFrame) -> DataFrame:
    """The generators' spans: key, kind, start, end, span, before, after; ``rows`` has key, body and base."""
    digit = F.rlike(F.col("body"), F.lit("[0-9]"))
    at = F.rlike(F.col("body"), F.lit(r"@|[(\[{]at[)\]}]|\x20at\x20"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,span:string>>")

    def of(kind: str) -> Column:
        shaped = F.transform(found(F.col("body"), WIDE[kind]), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["span"].alias("span")))
        return F.when(at if kind == "email" else digit, shaped).otherwise(none)

    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    rows = rows.filter(at | digit).withColumn("c", F.explode(F.filter(F.concat(*map(of, KINDS)), free)))
    return rows.select("key", "c.*", F.expr("substring(body, greatest(1, c.start - 23), least(24, c.start))").alias("before"), F.expr("substring(body, c.end + 1, 8)").alias("after"))


def _found(docs: DataFrame, model: GBTClassificationModel, limits: dict[str, float]) -> DataFrame:
    """doc_id, body, base and added spans of every row; rows of one doc_id are told apart by their texts."""
    body = clean(F.col("text"))
    rows = docs.select("doc_id", F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("key"), body.alias("body")).withColumn("base", base_spans(F.col("body")))
    scored = _scored(model, VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(with_features(_candidates(rows))))
    limit = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(limits[k])), KINDS[1:], F.when(F.col("kind") == KINDS[0], F.lit(limits[KINDS[0]])))
    rank = reduce(lambda c, k: c.when(F.col("kind") == KINDS[k], F.lit(k)), range(1, 4), F.when(F.col("kind") == KINDS[0], F.lit(0)))
    picked = scored.filter(F.col("probability") >= limit).select("key", "start", rank.alias("rank"), "end", "kind", "probability")
    picked = picked.groupBy("key").agg(F.array_sort(F.collect_set(F.struct((-F.col("probability")).alias("worse"), "start", "rank", "end", "kind"))).alias("ranked"))
    kept_kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def step(state: Column, c: Column) -> Column:
        taken = F.exists(state, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return F.when(taken, state).otherwise(F.concat(state, F.array(F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))))

    added = picked.select("key", F.aggregate("ranked", F.array().cast(kept_kind), step).alias("added"))
    return rows.join(added, "key", "left").select("doc_id", "body", "base", F.coalesce("added", F.array().cast(kept_kind)).alias("added"))


def find(docs: DataFrame, model: GBTClassificationModel, limits: dict[str, float]) -> DataFrame:
    """doc_id, base and added spans (arrays of start, rank, end, kind) of every document."""
    return _found(docs, model, limits).select("doc_id", "base", "added")


def redact(docs: DataFrame, model: GBTClassificationModel, limits: dict[str, float]) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets; of overlapping spans the first one counts.

    Every row is redacted by the spans of its own text, whatever its doc_id.
    """
    rows = _found(docs, model, limits).withColumn("spans", F.array_sort(F.concat("base", "added")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        lead = F.substring(F.col("body"), state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), F.concat(state["out"], lead, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))

    end = F.aggregate("spans", start, step, lambda state: F.concat(state["out"], F.substring(F.col("body"), state["at"] + 1, F.length("body"))))
    return rows.select("doc_id", end.alias("text"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
