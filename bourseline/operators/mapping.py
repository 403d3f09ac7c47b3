"""Mapping of news to securities, evidence and audit rules, candidates and vector search."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Titles of market-wide notices (fixed values).
NOTICE_TITLES = r"(?i)\b(?:SEBI turnover fees|settlement calendar|T-Bills?|government securities|commercial paper|currency derivatives|commodity derivatives|electronic gold receipts|daily bulletin|margin reporting schedule)\b"
INDEX_NOTICE = r"(?i)\bBSE\b.{0,60}\b(?:Index|IPO Index|notice|circular)\b"
SUSPENSION = r"(?i)\bSuspension of Trading\b"
#: Words that tell a company's name (fixed values).
COMPANY_WORDS = r"(?i)\b(?:Ltd|Limited|India|Industries|Corporation|Company|Finance|Bank|Pharma|Energy|Steel|Cement|Motors|Power|Technologies|Services|Enterprises)\b"

#: Rules of the cascade from the strongest on, with their confidence.
RULES = (("EXISTING_ID", 1.0), ("CURATED_ALIAS", 1.0), ("SCRIP_CODE", 1.0), ("SYMBOL", 0.98), ("NAME", 0.9), ("ALIAS", 0.88), ("CROSS_EXCHANGE", 0.85))
#: Stands for any exchange.
ANY = "*"


def notice_rules(category: Column, title: Column, company: Column) -> tuple[Column, Column, Column]:
    """Scope, status and confidence of news by the ordered notice rules; a null category passes none of them."""
    notice = category == "NOTICES"
    market = notice & (F.rlike(title, F.lit(NOTICE_TITLES)) | F.rlike(title, F.lit(INDEX_NOTICE)) | F.rlike(title, F.lit(SUSPENSION)))
    nameless = notice & title.isNotNull() & ~F.rlike(title, F.lit(COMPANY_WORDS))
    stock = (category != "NOTICES") & (F.trim(company) != "")
    scope = F.when(market | nameless, "MARKET").when(stock, "STOCK").otherwise("UNKNOWN")
    status = F.when(market | nameless, "NOT_APPLICABLE").when(stock, "PENDING").otherwise("UNMAPPED")
    return scope, status, F.when(market, F.lit(0.99)).when(nameless, F.lit(0.95))


def security_keys(securities: DataFrame) -> DataFrame:
    """rule, key, security_id: every key by which a security is found on any exchange, one row each; scrip_code is a column."""
    pairs = F.array(
        F.struct(F.lit("SCRIP_CODE").alias("rule"), F.col("scrip_code").cast("string").alias("key")),
        F.struct(F.lit("SYMBOL").alias("rule"), T.normalized_symbol(F.col("symbol")).alias("key")),
        F.struct(F.lit("NAME").alias("rule"), T.without_legal_suffix(T.normalized_name(F.col("instrument_name"))).alias("key")),
    )
    return securities.select("security_id", F.explode(pairs).alias("k")).select("k.rule", "k.key", "security_id").filter("key <> ''")


def news_keys(titled: DataFrame) -> DataFrame:
    """news_id with its keys for each rule; items without any key stay with none."""
    title = F.col("title")
    pairs = F.array(
        F.struct(F.lit("SCRIP_CODE").alias("rule"), T.scrip_code(title).alias("key")),
        F.struct(F.lit("SYMBOL").alias("rule"), T.normalized_symbol(T.title_symbol(title)).alias("key")),
        F.struct(F.lit("NAME").alias("rule"), T.without_legal_suffix(T.normalized_name(T.title_company(title))).alias("key")),
    )
    return titled.select("news_id", F.explode(pairs).alias("k")).select("news_id", "k.rule", "k.key")


def _keyed(rows: DataFrame, key: str, pairs: list[tuple[str, Column, Column]]) -> DataFrame:
    """rule, exchange, key beside an id; rows without a key fall away."""
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), where.alias("exchange"), value.alias("key")) for rule, where, value in pairs])
    return rows.select(key, F.explode(each).alias("k")).select(key, "k.rule", "k.exchange", "k.key").filter("key <> ''")


def exchange_keys(securities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keys of active securities (security_id, exchange, symbol, scrip_code, name) and aliases (security_id, alias, curated).

    Scrip codes hold on BSE, symbols and names on their exchange, ids and aliases on any; a name on any other exchange is the last rule.
    """
    name = T.without_legal_suffix(T.normalized_name(F.col("name")))
    any_, own = F.lit(ANY), F.col("exchange")
    keys = _keyed(securities, "security_id", [("EXISTING_ID", any_, F.col("security_id").cast("string")), ("SCRIP_CODE", F.lit("BSE"), F.col("scrip_code").cast("string")), ("SYMBOL", own, T.normalized_symbol(F.col("symbol"))), ("NAME", own, name), ("CROSS_EXCHANGE", any_, name)])
    alias = T.normalized_name(F.col("alias"))
    other = _keyed(aliases.join(securities.select("security_id"), "security_id", "left_semi"), "security_id", [("CURATED_ALIAS", any_, F.when(F.col("curated"), alias)), ("ALIAS", any_, F.when(~F.col("curated"), alias))])
    return keys.unionByName(other).distinct()


def event_keys(events: DataFrame) -> DataFrame:
    """The same keys of events (news_id, exchange, existing_id, scrip_code, symbol, company)."""
    company = T.normalized_name(F.col("company"))
    bare = T.without_legal_suffix(company)
    any_, own = F.lit(ANY), F.col("exchange")
    return _keyed(events, "news_id", [("EXISTING_ID", any_, F.col("existing_id").cast("string")), ("CURATED_ALIAS", any_, company), ("SCRIP_CODE", own, F.col("scrip_code").cast("string")), ("SYMBOL", own, T.normalized_symbol(F.col("symbol"))), ("NAME", own, bare), ("ALIAS", any_, company), ("CROSS_EXCHANGE", any_, bare)])


def cascade(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """The first rule with a candidate decides: one security is MAPPED, several are AMBIGUOUS, none is PENDING.

    Rows without a key do not enter the join; their items come back as PENDING.
    The securities of a key are one row with the least and the greatest id, which
    tells one from several, so a key of many securities multiplies no items.
    """
    order = reduce(lambda c, r: c.when(F.col("rule") == r[1][0], r[0]), list(enumerate(RULES))[1:], F.when(F.col("rule") == RULES[0][0], 0))
    on = ["rule", "exchange", "key"] if "exchange" in wanted.columns else ["rule", "key"]
    ends = keys.groupBy(*on).agg(F.min("security_id").alias("low"), F.max("security_id").alias("high"))
    # few keys serve many items: only those that are asked for meet the items, and a hot one is spread with its items
    asked = wanted.filter("key IS NOT NULL")
    found = asked.join(ends.join(asked.select(*on).distinct(), on, "left_semi"), on).withColumn("rank", order)
    # per rule first (partial aggregates), then the least rule: no item's candidates are collected
    per = found.groupBy("news_id", "rule", "rank").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = per.groupBy("news_id").agg(F.min_by(F.struct("rule", "low", "high"), "rank").alias("b"))
    best = wanted.select("news_id").distinct().join(best, "news_id", "left")
    hit, single = F.col("b").isNotNull(), F.col("b.low") == F.col("b.high")
    sure = reduce(lambda c, r: c.when(F.col("b.rule") == r[0], F.lit(r[1])), RULES[1:], F.when(F.col("b.rule") == RULES[0][0], F.lit(RULES[0][1])))
    return best.select("news_id", F.when(hit & single, F.col("b.low")).alias("security_id"), F.when(hit, F.col("b.rule")).alias("match_method"), F.when(hit, sure).alias("confidence"), F.when(~hit, "PENDING").when(single, "MAPPED").otherwise("AMBIGUOUS").alias("status"))


def shared_tokens(left: DataFrame, right: DataFrame, key: str, other: str, k: int) -> DataFrame:
    """The k candidates of each key that share most tokens (columns key or other, and token)."""
    scores = left.join(right, "token").groupBy(key, other).agg(F.count("*").alias("shared"))
    best = Window.partitionBy(key).orderBy(F.desc("shared"), other)
    return scores.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select(key, other, "shared")


#: Names that are compared at a time: a task holds one block of each side.
LEFT_BLOCK, RIGHT_BLOCK = 1024, 16384
#: Columns of the letter counts; letters that share one only weaken the bound.
_LETTERS = 64


def _letter_counts(names: list[str]) -> np.ndarray:
    counts = np.zeros((len(names), _LETTERS), dtype=np.uint16)
    for i, name in enumerate(names):
        np.add.at(counts[i], [ord(c) % _LETTERS for c in name], 1)
    return counts


def _best_names(a: str, own: np.ndarray, names: list[str], counts: np.ndarray, sizes: np.ndarray, owned: np.ndarray, matchers: dict[int, SequenceMatcher], least: float, k: int) -> list[tuple[int, float]]:
    """Place and ratio of the names (sorted by length) that the k best owners of names like ``a`` can have.

    Two names have no more letters in order than letters at all, so 2 x common / T
    bounds the ratio: names are tried from the greatest bound on, until it is
    below the ratio of the k-th owner.
    """
    low, high = np.searchsorted(sizes, (math.floor(len(a) * least / (2 - least)), math.ceil(len(a) * (2 - least) / least) + 1))
    bound = 2.0 * np.minimum(counts[low:high], own).sum(axis=1, dtype=np.int64) / (sizes[low:high] + len(a))
    near = np.flatnonzero(bound >= least)
    found: list[tuple[int, float]] = []
    worst = least
    for at in near[np.argsort(-bound[near], kind="stable")]:
        if bound[at] < worst:
            break
        place = int(low + at)
        if place not in matchers:
            matchers[place] = SequenceMatcher(None, "", names[place])
        matchers[place].set_seq1(a)
        ratio = matchers[place].ratio()
        if ratio >= worst:
            found.append((place, ratio))
            found.sort(key=lambda f: -f[1])
            n = 0
            for other, r in found:
                n += int(owned[other])
                if n >= k:
                    worst = r
                    break
    return [f for f in found if f[1] >= worst]


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.85, k: int = 5) -> DataFrame:
    """event_id, security_id, score: the k names of the same exchange with the greatest sequence ratio of ``least`` (0.85 or more) or over.

    No pair is lost.  Blocks of distinct names meet: the common letters of all
    pairs of two blocks are counted by arrays, and the ratio is computed only
    for pairs whose letters allow one among the k best.  All pairs of distinct
    names of an exchange are bounded so, a task holds one block of each side.

    Equal names count once: a name of many rows is compared once and joined
    back.  Rows without an exchange or name (null or empty) meet nobody; the
    ratio decides before it is rounded, ties go to the lower id.
    """
    if not 0.85 <= least <= 1:
        raise ValueError(f"the bound holds from 0.85 to 1: {least}")
    full = lambda rows: rows.filter("exchange IS NOT NULL AND name <> ''")
    # of the securities that share a name only the k of least id can be among the best
    order = Window.partitionBy("exchange", "name").orderBy("id")
    owners = full(right).select("exchange", "name", "id").distinct().withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= k)
    a = full(left).select("exchange", "name").distinct()
    b = owners.groupBy("exchange", "name").agg(F.count("*").alias("owned"))
    blocks = lambda rows, size, name: rows.groupBy("exchange").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = F.broadcast(blocks(a, LEFT_BLOCK, "as_").join(blocks(b, RIGHT_BLOCK, "bs_"), "exchange"))
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = a.join(grid, "exchange").select(F.col("exchange").alias("exchange_a"), F.col("name").alias("a_"), own("as_").alias("at"), every("bs_").alias("bt"))
    known = b.join(grid, "exchange").select(F.col("exchange").alias("exchange_b"), F.col("name").alias("b_"), "owned", every("as_").alias("at"), own("bs_").alias("bt"))

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(x) and len(y):
            y = y.iloc[np.argsort(y["b_"].str.len().to_numpy(), kind="stable")]
            names = y["b_"].tolist()
            counts, sizes, owned = _letter_counts(names), y["b_"].str.len().to_numpy(), y["owned"].to_numpy()
            matchers: dict[int, SequenceMatcher] = {}
            wanted = x["a_"].tolist()
            for name, letters in zip(wanted, _letter_counts(wanted), strict=True):
                rows += [(x["exchange_a"].iloc[0], name, names[i], r) for i, r in _best_names(name, letters, names, counts, sizes, owned, matchers, least, k)]
        return pd.DataFrame(rows, columns=["exchange", "a_", "b_", "raw"])

    near = asked.groupBy("exchange_a", "at", "bt").cogroup(known.groupBy("exchange_b", "at", "bt")).applyInPandas(met, "exchange string, a_ string, b_ string, raw double")
    scores = near.join(owners.select("exchange", F.col("name").alias("b_"), F.col("id").alias("security_id")), ["exchange", "b_"])
    best = Window.partitionBy("exchange", "a_").orderBy(F.desc("raw"), "security_id")
    kept = scores.withColumn("r_", F.row_number().over(best)).filter(F.col("r_") <= k).select("exchange", "a_", "security_id", "raw")
    events = left.select("exchange", F.col("name").alias("a_"), F.col("id").alias("event_id"))
    return events.join(kept, ["exchange", "a_"]).select("event_id", "security_id", (F.floor(F.col("raw") * 1e4 + 0.5) / 1e4).alias("score"))


def evidence_gate(event_isin: str, isin: str, event_symbol: str, symbol: str, event_exchange: str, exchange: str, similarity: str) -> tuple[Column, Column]:
    """REJECT on a conflict, MATCH_ELIGIBLE on a strong identifier or name, else ABSTAIN; and the reason."""
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    same = lambda a, b: both(a, b) & (F.col(a) == F.col(b))
    conflict = both(event_isin, isin) & (F.col(event_isin) != F.col(isin))
    strong = same(event_isin, isin) | (same(event_symbol, symbol) & same(event_exchange, exchange))
    named = (F.col(similarity) >= 0.85) & same(event_exchange, exchange)
    decision = F.when(conflict, "REJECT").when(strong | named, "MATCH_ELIGIBLE").otherwise("ABSTAIN")
    reason = F.when(conflict, "ISIN_MISMATCH").when(strong, "STRONG_IDENTIFIER").when(named, "STRONG_NAME_AND_EXCHANGE")
    return decision, reason


def audit_reason() -> tuple[Column, Column]:
    """The first reason that holds, and the last stage for the column ``reason``."""
    c = F.col
    reason = (
        F.when(~c("news_scope").eqNullSafe("STOCK"), "NOT_APPLICABLE")
        .when(c("published_at").isNull(), "NO_PUBLISHED_AT")
        .when(~c("mapping_status").eqNullSafe("MAPPED") | c("security_id").isNull(), "NOT_MAPPED")
        .when(c("n_rows") == 0, "NO_HISTORY")
        .when(c("n_rows") < 20, "INSUFFICIENT_HISTORY")
        .when(~c("has_features"), "FEATURES_MISSING")
        .when(~c("eligible"), "NOT_ELIGIBLE")
        .when(~c("is_scored"), "PREDICTION_PENDING")
        .otherwise("SCORED")
    )
    stage = F.when(c("reason") == "NOT_APPLICABLE", "ROUTING").when(c("reason") == "NOT_MAPPED", "MAPPING").when(c("reason").isin("NO_PUBLISHED_AT", "NO_HISTORY", "INSUFFICIENT_HISTORY"), "PIT").when(c("reason").isin("FEATURES_MISSING", "NOT_ELIGIBLE"), "FEATURES").otherwise("SCORING")
    return reason, stage


def feed_bucket(status: Column, asset: Column) -> Column:
    """EXCEPTIONS for what is open, else EQUITY or NON_EQUITY by the asset category."""
    open_ = F.upper(F.trim(F.coalesce(status, F.lit("")))).isin("", "PENDING", "AMBIGUOUS", "UNMAPPED")
    return F.when(open_, "EXCEPTIONS").when(F.upper(F.trim(F.coalesce(asset, F.lit("")))) == "EQUITY", "EQUITY").otherwise("NON_EQUITY")


def missing_or_stale(rows: DataFrame, derived: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows without a derived row (MISSING) or whose derived values differ, nulls compared as values (STALE)."""
    side = derived.select(*keys, *[F.col(v).alias(f"{v}__old") for v in values], F.lit(True).alias("there_"))
    joined = rows.join(side, keys, "left")
    stale = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"{v}__old")) for v in values])
    state = F.when(F.col("there_").isNull(), "MISSING").when(stale, "STALE")
    return joined.withColumn("state", state).filter("state IS NOT NULL").select(*rows.columns, "state")


#: Queries and rows that are compared at a time.
QUERY_BLOCK, ROW_BLOCK = 8192, 8192


def _nearest_of_block(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block of rows for each query of a block.

    A product of matrices tells which rows can be among them (within two
    steps of the grid of four digits); their cosines are then summed from left
    to right as a fold does, so that every engine agrees.
    """
    out = []
    ids, own = r["neighbour"].to_numpy(), r["e"].tolist()
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    fold = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    sizes = np.array([-1 if e is None else len(e) for e in own])
    for size in set(sizes[sizes > 0].tolist()):
        at = np.flatnonzero(sizes == size)
        vectors = np.stack([own[i] for i in at]).astype("float64")
        length = np.sqrt(fold(vectors * vectors))
        good = length > 0
        by_size[size] = at[good], vectors[good], length[good]
    for query, e in zip(q["vec_id"], q["q_"], strict=True):
        score, pool = np.full(len(ids), np.nan), np.arange(len(ids))
        if e is not None and len(e) in by_size:
            e = np.asarray(e, dtype="float64")
            at, vectors, length = by_size[len(e)]
            n = np.sqrt(fold(e * e))
            if n > 0:
                rough = vectors @ e / n / length
                rough[ids[at] == query] = -np.inf
                rough = np.where(np.isnan(rough), -np.inf, rough)
                least = np.partition(rough, -k)[-k] if len(rough) > k else -np.inf
                near = np.flatnonzero(rough >= least - 2e-4)
                score[at[near]] = fold(vectors[near] * e) / n / length[near]
                pool = at[near] if least > -np.inf else pool
        best = pool[np.lexsort((ids[pool], -np.floor(score[pool] * 1e4 + 0.5)))]
        best = best[ids[best] != query][:k]
        out.append(pd.DataFrame({"vec_id": query, "neighbour": ids[best], "score": [None if np.isnan(x) else x for x in score[best]]}))
    return pd.concat(out)


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """vec_id, neighbour, score: the k rows of greatest cosine for each query (columns vec_id, e), itself left out.

    Every query meets every row, in blocks: a task holds one block of each, and
    k rows a query leave it.  Vectors without a cosine come last, with a null.
    """
    q = queries.select("vec_id", F.col("e").alias("q_"))
    r = rows.select(F.col("vec_id").alias("neighbour"), "e")
    blocks = lambda x, size: F.broadcast(x.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("n_")))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    grid = blocks(q, QUERY_BLOCK).withColumnRenamed("n_", "qs_").crossJoin(blocks(r, ROW_BLOCK).withColumnRenamed("n_", "rs_"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = q.crossJoin(F.broadcast(grid)).select("vec_id", "q_", place("vec_id", "qs_").alias("qa_"), every("rs_").alias("ra_"))
    known = r.crossJoin(F.broadcast(grid)).select("neighbour", "e", every("qs_").alias("qb_"), place("neighbour", "rs_").alias("rb_"))

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": [], "neighbour": [], "score": []})
        return _nearest_of_block(a, b, k)

    scored = asked.groupBy("qa_", "ra_").cogroup(known.groupBy("qb_", "rb_")).applyInPandas(met, "vec_id long, neighbour long, score double")
    best = Window.partitionBy("vec_id").orderBy(F.desc(F.floor(F.col("score") * 1e4 + 0.5)), "neighbour")
    return scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")
