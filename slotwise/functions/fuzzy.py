"""Similarity of names, and the decision whether the best of a pool is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.binding import let

#: Weights of the score's parts, and the bounds of its bands.
WEIGHTS = {"lev": 0.45, "token_set": 0.25, "containment": 0.25, "prefix": 0.05}
ACCEPT_TOTAL, ACCEPT_MARGIN = 0.93, 0.06
LOW_TOTAL, LOW_MARGIN, LOW_CONTAINMENT = 0.80, 0.12, 0.85
FUZZY_TOKEN = 5


def tokens_equal(a: Column, b: Column) -> Column:
    """Equal, or both of five letters or more and one edit apart."""
    long = (F.least(F.length(a), F.length(b)) >= FUZZY_TOKEN) & (F.abs(F.length(a) - F.length(b)) <= 1)
    return (a == b) | (long & (F.levenshtein(a, b) <= 1))


def shared_tokens(a: Column, b: Column) -> Column:
    """How many tokens meet: equal ones first; then each of ``a`` in turn takes the first free one of ``b`` that is nearly equal.

    The second turn asks every token of ``a`` again, also those that met in the first: a token with two near
    partners can count twice, and the number can exceed the smaller set. It is kept so on purpose.
    """
    exact = F.array_intersect(a, b)
    free = F.array_except(b, a)
    zero = F.struct(free.alias("free"), F.lit(0).alias("n"))

    def take(acc: Column, token: Column) -> Column:
        hit = F.try_element_at(F.filter(acc["free"], lambda t: tokens_equal(token, t)), F.lit(1))
        return F.struct(F.when(hit.isNull(), acc["free"]).otherwise(F.array_remove(acc["free"], hit)).alias("free"), (acc["n"] + F.when(hit.isNull(), 0).otherwise(1)).alias("n"))

    n = F.size(exact)
    return F.when(n == F.least(F.size(a), F.size(b)), n).otherwise(n + F.aggregate(a, zero, take)["n"])


def score(a: Column, b: Column) -> Column:
    """struct(total, lev, token_set, containment, prefix) of two normalised names (structs of ``text.normalise``)."""

    def made(a: Column, b: Column, ta: Column, tb: Column, shared: Column) -> Column:
        longest = F.greatest(F.length(a["full"]), F.length(b["full"]), F.lit(1))
        union, least = F.size(ta) + F.size(tb) - shared, F.least(F.size(ta), F.size(tb))
        prefix = (F.array_contains(a["candidates"], b["full"]) | F.array_contains(b["candidates"], a["full"]) | F.arrays_overlap(a["candidates"], b["candidates"])).cast("int").cast("double")
        parts = F.struct((1 - F.levenshtein(a["full"], b["full"]) / longest).alias("lev"), F.when(union == 0, 0.0).otherwise(shared / union).alias("token_set"), F.when(least == 0, 0.0).otherwise(shared / least).alias("containment"), prefix.alias("prefix"))
        total = lambda p: WEIGHTS["lev"] * p["lev"] + WEIGHTS["token_set"] * p["token_set"] + WEIGHTS["containment"] * p["containment"] + WEIGHTS["prefix"] * p["prefix"]
        return let(parts, lambda p: F.struct(total(p).alias("total"), *[p[k].alias(k) for k in WEIGHTS]))

    def both(x: Column, y: Column) -> Column:
        return let(F.array_distinct(x["tokens"]), lambda tx: let(F.array_distinct(y["tokens"]), lambda ty: let(shared_tokens(tx, ty), lambda n: made(x, y, tx, ty, n))))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: both(p["a"], p["b"]))


def outcome(total: Column, margin: Column, containment: Column) -> Column:
    """The band of a best match; ``margin`` over the runner-up is null where there is none."""
    alone, m = margin.isNull(), F.coalesce(margin, F.lit(float("inf")))
    return (
        F.when((total >= ACCEPT_TOTAL) & (m >= ACCEPT_MARGIN), "accept-high")
        .when((total >= LOW_TOTAL) & (m < LOW_MARGIN), F.when(alone, "accept-low").otherwise("ambiguous"))
        .when((total >= LOW_TOTAL) & (containment >= LOW_CONTAINMENT), "accept-low")
        .otherwise("none")
    )


def token_keys(tokens: Column) -> Column:
    """Keys by which tokens that ``tokens_equal`` holds equal meet: the token, and of one of five letters or more the token without each letter."""
    short = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.length(t))))
    keys = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.when(F.length(t) >= FUZZY_TOKEN, short(t)).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(keys)


#: Parts of the work of meeting by token for each of the session's shuffle partitions; no key takes more than one part's work in one place.
PARTS_A_TASK = 4


def _keyed(names: DataFrame, name: str, forms: str) -> DataFrame:
    return names.select(name, F.explode(token_keys(F.col(f"{forms}.tokens"))).alias("_key"))


def heavy_keys(targets: DataFrame, items: DataFrame, parts: int) -> DataFrame:
    """(_key, a_parts, b_parts) of the keys under which more than one in ``parts`` of all pairs meet: fewer than ``parts`` keys, each dealt to a_parts by b_parts cells of about that work."""
    n, m = targets.groupBy("_key").agg(F.count("*").alias("n")), items.groupBy("_key").agg(F.count("*").alias("m"))
    work = n.join(m, "_key").select("_key", "n", "m", (F.col("n").cast("double") * F.col("m")).alias("w"))
    share = F.greatest(F.col("all") / parts, F.lit(1.0))
    heavy = work.crossJoin(F.broadcast(work.agg(F.sum("w").alias("all")))).where(F.col("w") > share)  # one row
    cells = F.ceil(F.col("w") / share)
    b_parts = F.least(F.ceil(F.sqrt(cells)), F.col("m"))
    return heavy.select("_key", F.least(F.ceil(cells / b_parts), F.col("n")).cast("int").alias("a_parts"), b_parts.cast("int").alias("b_parts"))


def candidate_names(targets: DataFrame, items: DataFrame, parts: int | None = None) -> DataFrame:
    """(target, item), once each, of the names that ``candidates`` pairs: only names move, and common tokens are met in many places."""
    t, i = _keyed(targets, "target", "a"), _keyed(items, "item", "b")
    heavy = F.broadcast(heavy_keys(t, i, parts or PARTS_A_TASK * max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))))  # fewer rows than parts
    one = lambda c: F.coalesce(c, F.lit(1))
    part = lambda name, n: F.pmod(F.xxhash64(name), one(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    left = t.join(heavy, "_key", "left").select("target", "_key", part("target", "a_parts").alias("_a"), every("b_parts").alias("_b"))
    right = i.join(heavy, "_key", "left").select("item", "_key", part("item", "b_parts").alias("_b"), every("a_parts").alias("_a"))
    return left.join(right, ["_key", "_a", "_b"]).select("target", "item").distinct()


def candidates(targets: DataFrame, items: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs of a target (target, a) and an item (item, b) that share a token or nearly (by ``token_keys``), each once; a and b are normalised names.

    Names that share none score below every bound of ``outcome``: all but the edit distance is nothing then. Names without a token meet nobody.
    A target's best and second best may share only common tokens with it, so no token is left out; the pairs of a common one are dealt out by their measured
    number (``heavy_keys``). Targets and items have a row a name.
    """
    return candidate_names(targets, items, parts).join(targets.select("target", "a"), "target").join(items.select("item", "b"), "item").select("target", "a", "item", "b")


def best_match(scored: DataFrame, target: str, item: str, order: str) -> DataFrame:
    """Of scored pairs (target, item, score, order): for each target the best item, its runner-up, margin and outcome.

    Equal totals fall to the lesser ``order``. The pairs come from ``candidates``, or from a join within a programme.
    """
    by = Window.partitionBy(target).orderBy(F.col("score.total").desc(), F.col(order))
    ranked = scored.withColumn("rank", F.row_number().over(by)).withColumn("next_total", F.lead("score.total").over(by)).withColumn("runner_up", F.lead(item).over(by)).where("rank = 1")
    margin = F.col("score.total") - F.col("next_total")
    return ranked.select(target, item, "runner_up", "score", margin.alias("margin"), outcome(F.col("score.total"), margin, F.col("score.containment")).alias("outcome"))
