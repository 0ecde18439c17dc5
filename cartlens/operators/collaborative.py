"""Matrix factors, item similarity and per-user recommendations."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens import constants as C
from cartlens.functions.scores import hash_bucket
from cartlens.operators.cooccurrence import both_directions, pair_sums
from cartlens.operators.interactions import user_routing, users_routed
from cartlens.operators.krylov import TOLERANCE, singular_vectors
from cartlens.operators.ranks import dense_codes, top_per_key
from cartlens.operators.topn import BLOCK_PRODUCTS, best_products
from cartlens.session import cut_lineage


# Products in the first range of candidates of users with little history.
FIRST_PRODUCTS = 4096


# --- factors -----------------------------------------------------------------


def matrix_shape(scores: DataFrame) -> tuple[int, int]:
    row = scores.agg(F.countDistinct("user_id"), F.countDistinct("product_id")).first()
    return row[0], row[1]


def default_rank(n_users: int, n_products: int) -> int:
    return min(C.MAX_RANK, n_users - 1, n_products - 1)


def factor_columns(factors: DataFrame) -> list[str]:
    return [name for name in factors.columns if name.startswith("f_")]


class Factors(NamedTuple):
    """``table``: ``product_id, code, f_0 … f_{rank-1}``; ``report``: ``component, strength, residual``."""

    table: DataFrame
    report: DataFrame
    passes: int


def fit_reported(scores: DataFrame, rank: int | None = None, tolerance: float = TOLERANCE) -> Factors:
    """Right singular vectors of the uncentred score matrix, with strength and residual of each.

    ``code`` numbers the products by ascending id. The steps are the same for any number of products; a direction
    whose residual stays above ``tolerance`` times the largest squared strength raises ``NotConverged``.
    """
    rank = rank or default_rank(*matrix_shape(scores))
    codes = cut_lineage(dense_codes(scores, "product_id"), "codes")
    cells = scores.where("score > 0").join(codes, "product_id").select("user_id", "code", "score")
    fitted = singular_vectors(cells, codes, rank, tolerance)
    report = scores.sparkSession.createDataFrame(
        [(i, float(s), float(r)) for i, (s, r) in enumerate(zip(fitted.strengths, fitted.residuals))],
        "component int, strength double, residual double",
    )
    return Factors(cut_lineage(codes.join(fitted.vectors, "code"), "factors"), report, fitted.passes)


def fit_factors(scores: DataFrame, rank: int | None = None) -> DataFrame:
    """One row per product: ``product_id, code, f_0 … f_{rank-1}``, see ``fit_reported``."""
    return fit_reported(scores, rank).table


def tall_factors(factors: DataFrame) -> DataFrame:
    names = factor_columns(factors)
    return factors.unpivot(["product_id"], names, "component", "value").withColumn(
        "component", F.substring("component", 3, 10).cast("int")
    )


def _known_cells(scores: DataFrame, factors: DataFrame) -> DataFrame:
    return scores.where("score > 0").select("user_id", "product_id", "score").join(
        factors, "product_id"
    )


def _projections(factors: DataFrame) -> list[Column]:
    return [F.sum(F.col("score") * F.col(name)).alias(name) for name in factor_columns(factors)]


def user_factors(scores: DataFrame, factors: DataFrame) -> DataFrame:
    """Project users on the factors: a join and one sum per component."""
    return _known_cells(scores, factors).groupBy("user_id").agg(*_projections(factors))


def _listed_users(
    scores: DataFrame, factors: DataFrame, top_n: int, requested: DataFrame | None, block: int
) -> DataFrame:
    names = factor_columns(factors)
    eligible = users_routed(scores, "factors")
    if requested is not None:
        eligible = eligible.join(requested, "user_id", "left_semi")
    if factors.isEmpty():
        raise ValueError("no factors to score with")
    cells = cut_lineage(_known_cells(scores.join(eligible, "user_id", "left_semi"), factors), "cells")
    users = cells.groupBy("user_id").agg(*_projections(factors))
    return best_products(users, cells.select("user_id", "code"), factors, names, top_n, block)


def factor_recommendations(
    scores: DataFrame,
    factors: DataFrame,
    top_n: int = C.HOMEPAGE_TOP_N,
    requested: DataFrame | None = None,
    block: int = BLOCK_PRODUCTS,
) -> DataFrame:
    """Best unseen products of users with enough history, by reconstructed score.

    Products are taken by falling length of their factors, so most users need few of them (see ``topn``).
    Users by products never exists as rows, and the list of seen products a task holds for a user stays
    within a block.
    """
    lists = _listed_users(scores, factors, top_n, requested, block)
    entries = F.posexplode(F.arrays_zip("products", "scores")).alias("at", "e")
    return lists.select("user_id", entries).select(
        "user_id",
        F.col("e.products").alias("product_id"),
        F.col("e.scores").alias("score"),
        (F.col("at") + 1).alias("rank"),
    )


def scoring_share(
    scores: DataFrame,
    factors: DataFrame,
    top_n: int = C.HOMEPAGE_TOP_N,
    requested: DataFrame | None = None,
    block: int = BLOCK_PRODUCTS,
) -> DataFrame:
    """One row: users, products, and how many of their pairs had to be scored for exact lists."""
    lists = _listed_users(scores, factors, top_n, requested, block)
    products = factors.agg(F.count("*")).scalar()
    return lists.agg(F.count("*").alias("users"), F.coalesce(F.sum("n_scored"), F.lit(0)).alias("scored")).select(
        "users",
        products.alias("products"),
        "scored",
        F.when(F.col("users") * products > 0, F.col("scored") / (F.col("users") * products)).alias("share"),
    )


def _ranked(scored: DataFrame, top_n: int) -> DataFrame:
    """Top of each user by rounded score; ties keep the lower product id first."""
    order = [F.desc("score"), F.asc("product_id")]
    return top_per_key(scored, ["user_id"], order, top_n).select(
        "user_id", "product_id", "score", "rank"
    )


def cell_split_rmse(scores: DataFrame, rank: int | None = None) -> DataFrame:
    """Error on hidden cells: hide a fifth of the positive scores, refit, reconstruct them."""
    hidden = hash_bucket(
        "cells", 5, F.col("user_id").cast("string"), F.col("product_id").cast("string")
    ) == 0
    kept = scores.withColumn("score", F.when(hidden, 0.0).otherwise(F.col("score")))
    factors = fit_factors(kept, rank)
    names = factor_columns(factors)
    users = user_factors(kept, factors).select("user_id", *[F.col(n).alias(f"u_{n}") for n in names])
    guess = sum((F.col(f"u_{n}") * F.col(n) for n in names), F.lit(0.0))
    error = F.col("score") - F.coalesce(guess, F.lit(0.0))
    return (
        scores.where(hidden & (F.col("score") > 0))
        .join(factors, "product_id")
        .join(users, "user_id", "left")
        .agg(
            F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
            F.count("*").alias("hidden_cells"),
        )
    )


# --- item similarity ---------------------------------------------------------


def item_similarity(
    scores: DataFrame, items: DataFrame | None = None, others: Column | None = None
) -> DataFrame:
    """Cosine of the score columns of two products, ``item_a < item_b``, where above 0.

    ``items``, distinct product ids, asks only for pairs with one of them; ``others``, a condition on
    ``product_id``, only for their pairs with products that meet it or are asked for themselves.
    """
    positive = scores.where("score > 0").select("user_id", "product_id", "score")
    norms = positive.groupBy("product_id").agg(
        F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm")
    )
    wanted = None
    if items is not None:
        wanted = "wanted"
        marked = items.select("product_id", F.lit(True).alias("marked"))
        positive = positive.join(marked, "product_id", "left").withColumn(
            wanted, F.coalesce("marked", F.lit(False))
        )
        if others is not None:
            positive = positive.where(F.col(wanted) | others)
    dots = pair_sums(positive, "user_id", "product_id", "score", wanted)
    side_a = norms.select(F.col("product_id").alias("item_a"), F.col("norm").alias("norm_a"))
    side_b = norms.select(F.col("product_id").alias("item_b"), F.col("norm").alias("norm_b"))
    return (
        dots.join(side_a, "item_a")
        .join(side_b, "item_b")
        .select(
            "item_a",
            "item_b",
            (F.col("total") / (F.col("norm_a") * F.col("norm_b"))).alias("similarity"),
        )
    )


def similarity_recommendations(
    scores: DataFrame,
    requested: DataFrame,
    top_n: int = C.HOMEPAGE_TOP_N,
    first: int = FIRST_PRODUCTS,
    enough: int = C.MIN_INTERACTIONS,
) -> DataFrame:
    """Best unseen products of users with little history, by similarity to what they know.

    ``requested`` holds distinct user ids; those with ``enough`` products or more get no list. Unknown users and users without a
    positive score get products at score 0.

    A score is a weighted mean of the user's own scores, so none exceeds the highest of them, and equal scores go to
    the lower id. So candidates are taken in ranges of rising product ids, about ``first`` products and then
    ever more: a list that is full of the highest score possible is final, and only the users without one
    meet the next range. Similarities are summed for those users' products and the range alone.
    """
    practised = user_routing(scores).where(F.col("n_interacted") >= enough)
    thin = requested.select("user_id").join(practised, "user_id", "left_anti")
    known = scores.where("score > 0").join(thin, "user_id", "left_semi")
    ranges = _id_ranges(scores, first)
    if len(ranges) > 1:
        known = cut_lineage(known, "known")
    open_, carried, finished = known, None, []
    for low, high in ranges:
        lists = _lists_in_range(scores, open_, low, high)
        if carried is not None:
            lists = lists.unionAll(carried)
        lists = _ranked(lists, top_n)
        if high is None:
            finished.append(lists)
            break
        lists = cut_lineage(lists, "lists")
        most = open_.groupBy("user_id").agg(F.round(F.max("score"), 4).alias("most"))
        full = lists.where(F.col("rank") == top_n).join(most, "user_id").where(F.col("score") >= F.col("most"))
        final = cut_lineage(full.select("user_id"), "final")
        finished.append(lists.join(final, "user_id", "left_semi"))
        carried = lists.join(final, "user_id", "left_anti").select("user_id", "product_id", "score")
        open_ = cut_lineage(open_.join(final, "user_id", "left_anti"), "open")
        if open_.isEmpty():
            break
    entry = F.struct((-F.col("score")).alias("place"), "product_id", "score")
    listed = reduce(DataFrame.unionAll, finished).groupBy("user_id").agg(F.collect_list(entry).alias("listed"))
    seen = known.groupBy("user_id").agg(F.collect_list("product_id").alias("seen"))
    users = thin.join(seen, "user_id", "left").join(listed, "user_id", "left")
    return _filled(users, scores, top_n, 2 * top_n + enough)


def _id_ranges(scores: DataFrame, first: int) -> list[tuple[int | None, int | None]]:
    """Ranges ``low < product_id <= high`` of about ``first`` products, then eight times as many, and so on."""
    ids = scores.select("product_id").distinct()
    number = ids.count()
    shares, size = [], first
    while size < number:
        shares.append(size / number)
        size *= 8
    cuts = ids.agg(F.percentile_approx("product_id", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts))
    return list(zip([None, *cuts], [*cuts, None]))


def _lists_in_range(scores: DataFrame, known: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """``user_id, product_id, score``: every unseen product of the range with a score above 0."""

    def inside(column: str) -> Column | None:
        found = [F.col(column) > low] if low is not None else []
        found += [F.col(column) <= high] if high is not None else []
        return reduce(lambda a, b: a & b, found) if found else None

    items = known.select("product_id").distinct()
    near = both_directions(item_similarity(scores, items, inside("product_id")), "similarity")
    if inside("other") is not None:
        near = near.where(inside("other"))
    weighted = F.sum(F.col("similarity") * F.col("score"))
    return (
        known.select("user_id", F.col("product_id").alias("item"), "score")
        .join(near, "item")
        .groupBy("user_id", F.col("other").alias("product_id"))
        .agg(
            F.round(weighted / (F.sum("similarity") + C.COSINE_EPSILON), 4).alias("score")
        )
        .join(known.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
        .where("score > 0")
    )


def _filled(users: DataFrame, scores: DataFrame, top_n: int, spare: int) -> DataFrame:
    """Lists of ``top_n`` rows from ``seen`` and ``listed``, the open places at score 0.

    The places go to the lowest ids neither seen nor listed. A thin user has
    seen only a few products and has at most ``top_n`` on the list, so the
    first ``spare`` ids of the catalogue hold every candidate.
    """
    lowest = (
        scores.select("product_id").distinct().orderBy("product_id").limit(spare)
        .agg(F.sort_array(F.collect_list("product_id"))).scalar()
    )
    zero = F.lit(0.0)
    no_ids = F.array().cast("array<long>")
    no_entries = F.array().cast("array<struct<place:double,product_id:long,score:double>>")
    taken = F.concat("seen", F.transform("listed", lambda entry: entry["product_id"]))
    padding = F.transform(
        F.slice(F.array_except("lowest", taken), F.lit(1), F.lit(top_n) - F.size("listed")),
        lambda product: F.struct(
            zero.alias("place"), product.alias("product_id"), zero.alias("score")
        ),
    )
    return (
        users.withColumn("lowest", lowest)
        .withColumn("seen", F.coalesce("seen", no_ids))
        .withColumn("listed", F.coalesce("listed", no_entries))
        .select("user_id", F.posexplode(F.sort_array(F.concat("listed", padding))).alias("at", "e"))
        .select("user_id", "e.product_id", "e.score", (F.col("at") + 1).alias("rank"))
    )


# --- homepage ----------------------------------------------------------------


def trending_products(lines: DataFrame, top_n: int = C.HOMEPAGE_TOP_N) -> DataFrame:
    """Products by units sold in delivered orders, ``lines`` with ``product_id, quantity``."""
    sold = lines.groupBy("product_id").agg(F.sum("quantity").alias("score"))
    return (
        sold.orderBy(F.desc("score"), F.asc("product_id"))
        .limit(top_n)
        .withColumn("rec_type", F.lit("trending"))
    )


def homepage_recommendations(
    requested: DataFrame,
    scores: DataFrame,
    trending: DataFrame,
    factors: DataFrame | None,
    top_n: int = C.HOMEPAGE_TOP_N,
) -> DataFrame:
    """One list per requested user: personal where it says anything, else best sellers.

    A personal list that is empty, or holds only scores of 0, gives way to the
    best sellers; so does every list while no factors have been fitted.
    """
    low, high = C.HOMEPAGE_RANGE
    if not low <= top_n <= high:
        raise ValueError(f"top_n must lie in {low}..{high}")
    users = requested.select("user_id").distinct()
    if factors is None:
        return with_best_sellers(users, None, trending)
    personal = factor_recommendations(scores, factors, top_n, users).unionByName(
        similarity_recommendations(scores, users, top_n)
    )
    return with_best_sellers(users, personal, trending)


def _best_sellers(trending: DataFrame) -> Column:
    entry = F.struct((-F.col("score")).alias("place"), "product_id", "score")
    return trending.agg(F.sort_array(F.collect_list(entry))).scalar()


def with_best_sellers(
    users: DataFrame, personal: DataFrame | None, trending: DataFrame
) -> DataFrame:
    """The personal list of each user where a score differs from 0, else the best sellers."""
    entry = "array<struct<place:double,product_id:long,score:double>>"
    if personal is None:
        listed = users.select("user_id", F.lit(None).cast(entry).alias("own"))
    else:
        # Lists hold at most ``top_n`` rows per user; ``place`` carries the rank.
        row = F.struct(F.col("rank").cast("double").alias("place"), "product_id", "score")
        lists = (
            personal.groupBy("user_id")
            .agg(F.sort_array(F.collect_list(row)).alias("own"), F.max(F.abs("score")).alias("best"))
            .where("best > 0")
            .select("user_id", "own")
        )
        listed = users.select("user_id").join(lists, "user_id", "left")
    has_own = F.col("own").isNotNull()
    return (
        listed.withColumn("best_sellers", _best_sellers(trending))
        .select(
            "user_id",
            F.when(has_own, "collaborative").otherwise("trending").alias("rec_type"),
            F.posexplode(F.coalesce("own", "best_sellers")).alias("at", "e"),
        )
        .select("user_id", "e.product_id", "e.score", (F.col("at") + 1).alias("rank"), "rec_type")
    )
