"""Records matched to the security master by identifiers, and the writes that follow a match.

A lookup table is aggregated to one row for each key before it is joined, so a
key that many securities share never multiplies the records, and records
without a key never enter a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _key(c: str) -> Column:
    """An identifier for comparison: trimmed upper case, null if blank."""
    return F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join on equal keys (rows' column: table's column); rows with a null key skip the shuffle's hot null key."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    side = table.select(*[F.col(v).alias(k) for k, v in on.items()], *[c for c in table.columns if c not in on.values()])
    extra = [c for c in side.columns if c not in on]
    found = rows.filter(known).join(side, list(on), "left").select(*rows.columns, *extra)
    return found.unionByName(rows.filter(~known), allowMissingColumns=True)


def by_isin_then_symbol(records: DataFrame, master: DataFrame) -> DataFrame:
    """Two passes: membership of the ISIN, then the symbol for those that are left. Adds security_id and match_method."""
    rows = records.withColumns({"isin_k": _key("isin"), "symbol_k": _key("symbol")})
    isins = master.select(_key("isin").alias("i"), "security_id").filter("i IS NOT NULL").groupBy("i").agg(F.min("security_id").alias("by_isin"))
    symbols = master.select(_key("symbol").alias("s"), "security_id").filter("s IS NOT NULL").groupBy("s").agg(F.min("security_id").alias("by_symbol"))
    rows = lookup(lookup(rows, isins, {"isin_k": "i"}), symbols, {"symbol_k": "s"})
    method = F.when(F.col("by_isin").isNotNull(), "ISIN").when(F.col("by_symbol").isNotNull(), "SYMBOL").otherwise("UNMATCHED")
    return rows.select(*records.columns, F.coalesce("by_isin", "by_symbol").alias("security_id"), method.alias("match_method"))


def actions_to_master(records: DataFrame, master: DataFrame) -> DataFrame:
    """A real ISIN first; else the symbol, within the record's series if it names one. The least security_id wins."""
    real = F.when(T.isin_shape(_key("isin")), _key("isin"))
    rows = records.withColumns({"isin_k": real, "symbol_k": _key("symbol"), "series_k": _key("series")})
    isins = master.select(_key("isin").alias("i"), "security_id").filter("i IS NOT NULL").groupBy("i").agg(F.min("security_id").alias("by_isin"))
    own = master.select(_key("symbol").alias("s"), _key("series").alias("r"), "security_id").filter("s IS NOT NULL")
    series = own.filter("r IS NOT NULL").groupBy("s", "r").agg(F.min("security_id").alias("by_series"))
    symbols = own.groupBy("s").agg(F.min("security_id").alias("by_symbol"))
    rows = lookup(lookup(lookup(rows, isins, {"isin_k": "i"}), series, {"symbol_k": "s", "series_k": "r"}), symbols, {"symbol_k": "s"})
    symbol = F.when(F.col("series_k").isNull(), F.col("by_symbol")).otherwise(F.col("by_series"))
    method = F.when(F.col("by_isin").isNotNull(), "ISIN").when(symbol.isNotNull(), "SYMBOL")
    return rows.select(*records.columns, F.coalesce(F.col("by_isin"), symbol).alias("security_id"), method.alias("match_method"))


def news_to_master(records: DataFrame, master: DataFrame, exchange: str = "NSE") -> DataFrame:
    """ISIN with confidence 1.0, else symbol with 0.95, else PENDING, among the exchange's securities; of those with one key the last loaded counts."""
    master = master.filter(F.col("exchange") == exchange)
    rows = records.withColumns({"isin_k": _key("isin"), "symbol_k": _key("symbol")})
    isins = master.select(_key("isin").alias("i"), "security_id").filter("i IS NOT NULL").groupBy("i").agg(F.max("security_id").alias("by_isin"))
    symbols = master.select(_key("symbol").alias("s"), "security_id").filter("s IS NOT NULL").groupBy("s").agg(F.max("security_id").alias("by_symbol"))
    rows = lookup(lookup(rows, isins, {"isin_k": "i"}), symbols, {"symbol_k": "s"})
    confidence = F.when(F.col("by_isin").isNotNull(), F.lit(1.0)).when(F.col("by_symbol").isNotNull(), F.lit(0.95))
    return rows.select(*records.columns, F.coalesce("by_isin", "by_symbol").alias("security_id"), confidence.alias("confidence"), F.when(confidence.isNull(), "PENDING").otherwise("MAPPED").alias("status"))


def prices_to_master(prices: DataFrame, master: DataFrame, exchange: str = "BSE") -> DataFrame:
    """One security for the ISIN and traded on the exchange: its tag; several: AMBIGUOUS; none or another exchange: UNMATCHED."""
    counted = master.select(_key("isin").alias("i"), "security_id", "exchange", "exchange_tag").filter("i IS NOT NULL").groupBy("i").agg(F.count("*").alias("n_"), F.min("security_id").alias("id_"), F.min(F.upper("exchange")).alias("exchange_"), F.min(F.upper("exchange_tag")).alias("tag_"))
    rows = lookup(prices.withColumn("isin_k", _key("isin")), counted, {"isin_k": "i"})
    single = F.col("n_") == 1
    tag = F.when(F.col("n_") > 1, "AMBIGUOUS").when(single & F.col("tag_").isin("BOTH", exchange), F.col("tag_")).when(single & (F.col("exchange_") == exchange), exchange).otherwise("UNMATCHED")
    return rows.select(*prices.columns, tag.alias("resolution"), F.when(tag.isin("BOTH", exchange), F.col("id_")).alias("security_id"))


def instrument_id(text: Column) -> Column:
    """An instrument number that a spreadsheet wrote as a decimal."""
    return F.replace(F.trim(text), F.lit(".0"), F.lit(""))


def first_isin_of_symbol(rows: DataFrame, order: str) -> DataFrame:
    """symbol, isin: of the rows of one symbol the first in order."""
    return rows.filter("symbol IS NOT NULL").groupBy("symbol").agg(F.min_by(F.struct("isin"), order).alias("f")).select("symbol", "f.isin")


def surrogate_ids(rows: DataFrame, after: int, buckets: int | None = None) -> DataFrame:
    """security_id beyond ``after`` for each row, numbered within hash buckets and by the buckets' counts, so no task holds all rows.

    There are four buckets for each shuffle partition, so they follow the size of the job.
    """
    buckets = buckets or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("bucket_", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)))
    sizes = placed.groupBy("bucket_").agg(F.count("*").alias("n_"))
    ahead = sizes.select("bucket_", F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))
    own = F.row_number().over(Window.partitionBy("bucket_").orderBy(*rows.columns))
    return placed.join(F.broadcast(ahead), "bucket_").withColumn("security_id", F.lit(after) + F.col("ahead_") + own).drop("bucket_", "ahead_")


def get_or_create(master: DataFrame, seen: DataFrame, describing: list[str]) -> DataFrame:
    """The master after a file.

    A row of the file means the security of least id that has its ISIN, or that
    has no ISIN and its symbol and series (a missing series equals a missing
    one). That one security takes the row's descriptive values; of several rows
    that mean it, those of the last symbol and series. Rows that mean none are
    added with new ids, one for each ISIN, or symbol and series. A row without
    ISIN and symbol names no security: it changes and adds nothing.
    """
    bare = F.when(_key("symbol").isNotNull(), F.concat_ws("|", _key("symbol"), F.coalesce(_key("series"), F.lit(""))))
    old = master.select("security_id", _key("isin").alias("i"), bare.alias("b"))
    isins = old.filter("i IS NOT NULL").groupBy("i").agg(F.min("security_id").alias("by_isin"))
    bares = old.filter("i IS NULL AND b IS NOT NULL").groupBy("b").agg(F.min("security_id").alias("by_bare"))
    rows = seen.withColumns({"isin_k": _key("isin"), "bare_k": bare})
    rows = lookup(lookup(rows, isins, {"isin_k": "i"}), bares, {"bare_k": "b"}).withColumn("target_", F.least("by_isin", "by_bare"))
    order = F.struct("symbol", "series")
    new = rows.filter("target_ IS NOT NULL").groupBy("target_").agg(*[F.max_by(F.struct(c), order).alias(f"{c}__new") for c in describing])
    side = new.select(F.col("target_").alias("security_id"), *[f"{c}__new" for c in describing], F.lit(True).alias("hit_"))
    kept = master.join(side, "security_id", "left").select(*[F.when(F.col("hit_"), F.col(f"{c}__new")[c]).otherwise(F.col(c)).alias(c) if c in describing else F.col(c) for c in master.columns])
    left = rows.filter("target_ IS NULL").withColumn("key_", F.coalesce("isin_k", "bare_k")).filter("key_ IS NOT NULL")
    fresh = left.groupBy("key_").agg(*[F.max_by(F.struct(c), order).alias(c) for c in seen.columns]).select(*[F.col(c)[c].alias(c) for c in seen.columns])
    last = master.agg(F.max("security_id")).first()[0] or 0
    return kept.unionByName(surrogate_ids(fresh, last), allowMissingColumns=True)


def retagged(master: DataFrame, other: DataFrame, own_tag: str = "NSE") -> DataFrame:
    """Securities of one exchange whose ISIN the other exchange lists become BOTH."""
    listed = other.select(_key("isin").alias("isin_k")).filter("isin_k IS NOT NULL").distinct().withColumn("there_", F.lit(True))
    rows = lookup(master.withColumn("isin_k", _key("isin")), listed.withColumnRenamed("isin_k", "i"), {"isin_k": "i"})
    return rows.select(*[F.when(F.col("there_") & (F.col("exchange_tag") == own_tag), "BOTH").otherwise(F.col("exchange_tag")).alias(c) if c == "exchange_tag" else F.col(c) for c in master.columns])


def kept_mappings(now: DataFrame, found: DataFrame) -> DataFrame:
    """A valid mapping keeps its security, method and confidence; any other takes what was found."""
    side = found.select("news_id", *[F.col(c).alias(f"{c}__new") for c in ("security_id", "match_method", "confidence", "mapping_status")])
    valid = F.col("mapping_status").eqNullSafe("MAPPED") & F.col("security_id").isNotNull()
    columns = [F.when(valid | F.col(f"{c}__new").isNull() & (c != "security_id"), F.col(c)).otherwise(F.col(f"{c}__new")).alias(c) for c in ("security_id", "match_method", "confidence", "mapping_status")]
    return now.join(side, "news_id", "left").select("news_id", *columns)


def merged_candidates(fixed: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """item, security_id, method, score, status, in_both: candidates by rules stay as they are, those of the vector search
    alone need a review; by score and id the best k of each item."""
    a = fixed.select("item", "security_id", F.struct("method", "score", "status").alias("fixed"))
    b = vectors.select("item", "security_id", F.struct("score").alias("vector"))
    rows = a.join(b, ["item", "security_id"], "full")
    rows = rows.select("item", "security_id", F.coalesce("fixed.method", F.lit("VECTOR_RAG")).alias("method"), F.coalesce("fixed.score", "vector.score").alias("score"), F.coalesce("fixed.status", F.lit("NEEDS_REVIEW")).alias("status"), (F.col("fixed").isNotNull() & F.col("vector").isNotNull()).alias("in_both"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "security_id"))
    return rows.withColumn("rank", best).filter(F.col("rank") <= k)


#: Rows of one key that a task of the join holds of each side.
KEY_BLOCK = 512


def canonical_matches(wanted: DataFrame, master: DataFrame) -> DataFrame:
    """group_id, security_id, by: every security that agrees in ISIN, symbol or name; three equality joins in place of one OR.

    A pair comes from one join only, that of its first rule and least common
    key, and its other rules are read off the two rows, so no pair is shuffled.
    The rows of a key that many share are dealt into blocks, and each pair of
    blocks is joined by itself.
    """
    rules = ("isin", "symbol", "name")
    keys = lambda rows, id_, to: rows.groupBy(F.col(id_).alias(f"{id_}_")).agg(*[F.sort_array(F.collect_set(_key(c))).alias(f"{c}_{to}") for c in rules])
    a, b = keys(wanted, "group_id", "a"), keys(master, "security_id", "b")
    common = lambda c: F.arrays_overlap(f"{c}_a", f"{c}_b")
    parts = []
    for at, c in enumerate(rules):
        left, right = (rows.select("*", F.explode(f"{c}_{to}").alias(f"k{to}_")) for rows, to in ((a, "a"), (b, "b")))
        # keys of both sides only, with the number of blocks of each
        sizes = lambda rows, to: rows.groupBy(F.col(f"k{to}_").alias("k_")).agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias(f"n{to}_"))
        both = sizes(left, "a").join(sizes(right, "b"), "k_")
        own = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = left.join(both, F.col("ka_") == F.col("k_")).withColumn("ia_", own("group_id_", "na_")).select(*a.columns, F.col("k_").alias("ka_"), "ia_", every("nb_").alias("ja_"))
        right = right.join(both, F.col("kb_") == F.col("k_")).withColumn("jb_", own("security_id_", "nb_")).select(*b.columns, F.col("k_").alias("kb_"), "jb_", every("na_").alias("ib_"))
        pairs = left.join(right, (F.col("ka_") == F.col("kb_")) & (F.col("ia_") == F.col("ib_")) & (F.col("ja_") == F.col("jb_")))
        first = [~common(x) for x in rules[:at]]
        once = (F.size(f"{c}_a") == 1) | (F.size(f"{c}_b") == 1) | (F.array_min(F.array_intersect(f"{c}_a", f"{c}_b")) == F.col("ka_"))
        names = [F.lit(c.upper()), *[F.when(common(x), x.upper()) for x in rules[at + 1 :]]]
        parts.append(pairs.filter(reduce(lambda x, y: x & y, first, once)).select(F.col("group_id_").alias("group_id"), F.col("security_id_").alias("security_id"), _listed_rules(names).alias("by")))
    return reduce(DataFrame.unionByName, parts)


def _listed_rules(names: list[Column]) -> Column:
    """Names of rules in the order of the alphabet, nulls left out."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*names))), ",")


def single_eligible(candidates: DataFrame) -> DataFrame:
    """group_id, eligible, outcome: exactly one eligible candidate decides, several or none do not."""
    n = F.count_if("eligible")
    outcome = F.when(n == 1, "MATCH").when(n > 1, "MULTIPLE_ELIGIBLE").otherwise("NO_ELIGIBLE_CANDIDATE")
    return candidates.groupBy("group_id").agg(n.alias("eligible"), outcome.alias("outcome"), F.min(F.when(F.col("eligible"), F.col("security_id"))).alias("least")).select("group_id", "eligible", "outcome", F.when(F.col("outcome") == "MATCH", F.col("least")).alias("security_id"))


#: Fields of a security that can prove an identity, in the order in which they are compared (fixed values).
IDENTITY_FIELDS = ("isin", "symbol", "nse_symbol", "bse_symbol", "instrument_name", "nse_name", "nse_short_name", "nse_alias", "bse_name", "bse_short_name", "bse_alias", "bse_scrip_code")


def _plain(text: Column) -> Column:
    """Upper case, white space as single blanks, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.upper(text.cast("string")), r"\s+", " ")), F.lit(""))


def verified(candidates: DataFrame, master: DataFrame) -> DataFrame:
    """Candidates of a vector search (``query_text``, ``security_id``) checked field by field; the distance proves nothing.

    Adds ``verdict``, ``matched_field``, ``matched_value``, ``reason`` and
    ``fields``, the comparison of each identity field: AGREE, DIFFER, or UNKNOWN
    where the security or the query has no value. One field that agrees is a
    MATCH by that field, several are a MATCH by MULTIPLE, none is a REVIEW; a
    security that is absent or inactive is NO_CANONICAL_MATCH. Identity fields
    that the master lacks are UNKNOWN. The master's values are made plain once
    for each security, not for each candidate.
    """
    known = [c for c in IDENTITY_FIELDS if c in master.columns]
    side = master.filter("is_active").select("security_id", F.struct(*[F.col(c).cast("string").alias(c) for c in known]).alias("own_"), F.struct(*[_plain(F.col(c)).alias(c) for c in known]).alias("plain_"))
    rows = candidates.join(side, "security_id", "left").withColumn("asked_", _plain(F.col("query_text")))

    def compared(c: str) -> Column:
        value = F.col("own_")[c] if c in known else F.lit(None).cast("string")
        same = F.col("plain_")[c] == F.col("asked_") if c in known else F.lit(None).cast("boolean")
        return F.struct(F.lit(c.upper()).alias("field"), value.alias("value"), F.when(same.isNull(), "UNKNOWN").when(same, "AGREE").otherwise("DIFFER").alias("state"))

    rows = rows.withColumn("fields", F.array(*map(compared, IDENTITY_FIELDS)))
    agree = F.filter("fields", lambda x: x["state"] == "AGREE")
    n, here = F.size(agree), F.col("own_").isNotNull()
    verdict = F.when(~here, "NO_CANONICAL_MATCH").when(n > 0, "MATCH").otherwise("REVIEW")
    reason = (
        F.when(~here, "security is absent or inactive")
        .when(n == 1, "one identity field agrees")
        .when(n > 1, "several identity fields agree")
        .otherwise("no identity field agrees")
    )
    return rows.select(
        *candidates.columns, verdict.alias("verdict"), F.when(n > 1, "MULTIPLE").when(n == 1, F.get(agree, F.lit(0))["field"]).alias("matched_field"),
        F.when(n > 1, F.col("query_text")).when(n == 1, F.get(agree, F.lit(0))["value"]).alias("matched_value"), reason.alias("reason"), "fields",
    )
