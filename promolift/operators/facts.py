"""What customers bought, reduced to one row per customer, product or coupon.

Each function ends in rows that are unique on their key, built with map-side
combining, so measures can look facts up instead of joining raw transactions.
"""

from __future__ import annotations

from functools import reduce
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import is_digital, is_paper, panel_arm, stage_is
from promolift.functions.joins import even_join
from promolift.operators.modules import CampaignFrames

PERIODS = ("pre", "dur", "post")
#: Offers with at most this many products bring their list along with each exposure.
LONGEST_LIST = 256


def exposed_pairs(frames: CampaignFrames) -> DataFrame:
    """Distinct (id, offer) a customer was exposed to."""
    return frames.base.filter(stage_is(V.EXPOSED)).select("id", "offer_code").distinct()


def purchase_counts(items: DataFrame) -> DataFrame:
    """Lines per (id, product) in each period."""
    lines = [F.count_if(f"in_{period}").alias(f"n_{period}") for period in PERIODS]
    return items.groupBy("id", "prod_code").agg(*lines)


def purchases_of(frames: CampaignFrames) -> DataFrame:
    """The purchase counts, read back if they were written."""
    return purchase_counts(frames.items) if frames.purchases is None else frames.purchases


def featured_buyers(frames: CampaignFrames) -> DataFrame:
    """Customers who bought a product of any offer during the campaign."""
    if frames.purchases is None:
        bought = frames.items.filter("in_dur").select("id", "prod_code").distinct()
    else:
        bought = frames.purchases.filter("n_dur > 0").select("id", "prod_code")
    featured = frames.offer_product.select("prod_code").distinct()
    buyers = even_join(bought, featured, ["prod_code"], "left_semi").select("id").distinct()
    return buyers.withColumn("bought_featured", F.lit(True))


def customer_arms(base: DataFrame) -> DataFrame:
    """The arms each customer was allocated to; a struct keeps an arm that is NULL."""
    return base.filter(stage_is(V.ALLOCATED)).groupBy("id").agg(
        F.collect_set(F.struct("event_control_flag")).alias("arms"))


def coupon_facts(base: DataFrame) -> DataFrame:
    """One row per redeemed (id, offer), NULL keys included.

    ``n_coupon``, ``n_digital`` and ``n_paper`` are its redemptions, once for each
    arm the customer was allocated to; ``exposed`` tells whether the customer was
    sent the coupon; ``arms`` lists those arms. Exposures and redemptions meet in
    one grouping, so no list of exposed coupons is joined.
    """
    redeemed = stage_is(V.REDEEMED)
    count_of = lambda condition: F.count_if(redeemed & condition)
    coupons = base.filter(stage_is(V.EXPOSED, V.REDEEMED)).groupBy("id", "offer_code").agg(
        F.count_if(redeemed).alias("n_coupon"), count_of(is_digital()).alias("n_digital"),
        count_of(is_paper()).alias("n_paper"), F.bool_or(stage_is(V.EXPOSED)).alias("exposed"),
    ).filter("n_coupon > 0")
    counts = ("n_coupon", "n_digital", "n_paper")
    times = F.greatest(F.coalesce(F.size("arms"), F.lit(1)), F.lit(1))
    return even_join(coupons, customer_arms(base), ["id"]).withColumns({name: F.col(name) * times for name in counts})


def coupons_of(frames: CampaignFrames) -> DataFrame:
    """The coupon facts, read back if they were written."""
    return coupon_facts(frames.base) if frames.coupons is None else frames.coupons


def coupon_outcomes(
    purchases: DataFrame, pairs: DataFrame, offer_product: DataFrame, products: DataFrame | None = None
) -> DataFrame:
    """Per exposed (id, offer): how buying its products changed over the periods.

    With ``products`` also ``unbought``: its products not bought before or after
    the campaign, in loyal categories. A category is loyal for a customer who
    bought in it both before and after. The number is all products of the offer
    in loyal categories less those the customer did buy.

    Purchases and exposures are stacked and grouped by customer once, and no pair
    of a purchase and an exposure is made before that: an exposure brings the
    product list of its offer, a purchase the long offers its product is in (a
    list of offers, shorter than all listed products over ``LONGEST_LIST``). A
    customer's row then holds each bought product and each exposure once, and
    the flags of an exposure come from comparing two short lists.
    """
    category = "prod_hier_l20_code"
    listed = offer_product.select("offer_code", "prod_code").where("prod_code is not null").distinct()
    sizes = listed.groupBy("offer_code").agg((F.count("*") <= LONGEST_LIST).alias("short"))
    sized = listed.join(sizes, "offer_code")
    of_offer = sized.groupBy("offer_code").agg(
        F.collect_list(F.when(F.col("short"), F.col("prod_code"))).alias("list"))
    of_product = sized.where(~F.col("short")).groupBy("prod_code").agg(F.collect_list("offer_code").alias("long"))
    pre, dur, post = (F.col(f"n_{period}") for period in PERIODS)
    outcomes = {
        "tried": (dur > 0) & (post == 0),
        "repeated": (dur > 0) & (post == 1),
        "adopted": (dur > 0) & (post > 1),
        "lapsed": (pre > 0) & (post == 0),
        "retained": (pre > 0) & (post > 0),
    }
    flags = [condition.alias(name) for name, condition in outcomes.items()]
    no_strings, no_cats = (F.lit(None).cast(kind) for kind in ("array<string>", "array<struct<of:string,n:bigint>>"))

    if products is None:
        of_offer = of_offer.withColumn("cats", no_cats)
        kinds = of_product.withColumn("category", F.lit(None).cast("string"))
    else:
        placed = products.select("prod_code", F.col(category).alias("category")).where("category is not null")
        per_category = offer_product.join(placed, "prod_code").groupBy("offer_code", "category").agg(
            F.count("*").alias("n"))
        cats = per_category.groupBy("offer_code").agg(
            F.collect_list(F.struct(F.col("category").alias("of"), "n")).alias("cats"))
        of_offer = of_offer.join(cats, "offer_code", "left")
        kinds = placed.join(of_product, "prod_code", "full")

    bought = even_join(purchases.where("prod_code is not null"), kinds, ["prod_code"]).select(
        "id", F.struct(
            "prod_code", "category", F.coalesce("long", F.array().cast("array<string>")).alias("long"),
            (pre > 0).alias("before"), (post > 0).alias("after"), *flags).alias("bought"))
    exposed = even_join(pairs.where("id is not null and offer_code is not null"), of_offer, ["offer_code"]).select(
        "id", F.struct("offer_code", F.coalesce("list", no_strings).alias("list"), "cats").alias("exposed"))
    both = bought.unionByName(exposed, allowMissingColumns=True).groupBy("id").agg(
        F.collect_list("bought").alias("bought"), F.collect_list("exposed").alias("exposed"),
    ).where((F.size("exposed") > 0) & (F.size("bought") > 0))

    def of(name: str, condition) -> list:
        """Products, and long offers of products, that the condition holds for."""
        kept = F.filter("bought", condition)
        return [
            F.transform(kept, lambda x: x["prod_code"]).alias(f"{name}_products"),
            F.flatten(F.transform(kept, lambda x: x["long"])).alias(f"{name}_long")]

    def categories(when: str):
        return F.transform(
            F.filter("bought", lambda x: x[when] & x["category"].isNotNull()), lambda x: x["category"])

    facts: list = []
    for name in outcomes:
        facts += of(name, itemgetter(name))
    in_loyal = F.array_intersect(categories("before"), categories("after"))
    rows = both.select("id", "bought", "exposed", in_loyal.alias("loyal"))
    facts += of("loyal", lambda x: (x["before"] | x["after"]) & F.array_contains("loyal", x["category"]))
    # The lists are made once for a customer, below the explode, not for each exposure.
    lists = rows.select("id", "exposed", "loyal", *facts)
    each = lists.select(*[name for name in lists.columns if name != "exposed"], F.explode("exposed").alias("e"))
    offer, short = F.col("e.offer_code"), F.coalesce("e.list", F.array().cast("array<string>"))
    touched = [
        (F.arrays_overlap(short, f"{name}_products") | F.array_contains(f"{name}_long", offer)).alias(name)
        for name in outcomes]
    every = F.aggregate(
        F.filter(F.coalesce("e.cats", F.array().cast("array<struct<of:string,n:bigint>>")),
                 lambda c: F.array_contains("loyal", c["of"])),
        F.lit(0).cast("bigint"), lambda total, c: total + c["n"])
    # A product may be in several categories, so each (product, category) counts.
    did_buy = F.size(F.filter("loyal_products", lambda x: F.array_contains(short, x))) + F.size(
        F.filter("loyal_long", lambda x: x == offer))
    return each.select("id", offer.alias("offer_code"), *touched, (every - did_buy).alias("unbought"))


def held_transactions(items: DataFrame) -> DataFrame:
    """(transaction, id) with the periods it has lines in. A line without a number is its customer's alone."""
    flags = [F.bool_or(f"in_{period}").alias(f"in_{period}") for period in PERIODS]
    return items.select(
        F.coalesce("transaction_fid", F.concat(F.lit("\0"), "id")).alias("transaction_fid"),
        "id", *[f"in_{period}" for period in PERIODS], F.col("transaction_fid").isNotNull().alias("numbered"),
    ).groupBy("transaction_fid", "id").agg(*flags, F.bool_or("numbered").alias("numbered"))


def transaction_owners(held: DataFrame) -> DataFrame:
    """Per transaction its least and greatest customer, its periods, and whether it is numbered.

    Both ends are the same where one customer owns it; the state of two parts of
    a transaction adds up to that of the whole, so it is built on the map side.
    """
    flags = [F.bool_or(f).alias(f) for f in (*[f"in_{p}" for p in PERIODS], "numbered")]
    return held.groupBy("transaction_fid").agg(F.min("id").alias("id"), F.max("id").alias("last"), *flags)


def shared_transactions(held: DataFrame) -> DataFrame:
    """(transaction, id) rows of the few transactions that several customers share."""
    several = transaction_owners(held).filter("id <> last").select("transaction_fid")
    return even_join(held, several, ["transaction_fid"], "left_semi").filter("numbered")


def visit_facts(held: DataFrame, shared: DataFrame) -> DataFrame:
    """Transactions as facts of a customer.

    A transaction of one customer is counted once in every group that customer
    is in, so its number is a fact of the customer (``own_<period>``) and no
    (group, transaction) pair has to be made. ``any_<period>`` covers shared
    transactions too, and lines without a number.
    """
    flags = [*[f"in_{p}" for p in PERIODS], "numbered"]
    single = transaction_owners(held).filter("id = last").select("id", *flags, F.lit(True).alias("own"))
    either = single.union(shared.select("id", *flags, F.lit(False)))
    counted = {p: F.count_if(F.col(f"in_{p}") & F.col("own") & F.col("numbered")) for p in PERIODS}
    return either.groupBy("id").agg(
        *[count.alias(f"own_{p}") for p, count in counted.items()],
        *[F.bool_or(f"in_{p}").alias(f"any_{p}") for p in PERIODS],
    )


def shared_visits_of(frames: CampaignFrames) -> DataFrame:
    """Shared transactions, read back if they were written."""
    if frames.shared_visits is not None:
        return frames.shared_visits
    return shared_transactions(held_transactions(frames.items))


def visits_of(frames: CampaignFrames) -> DataFrame:
    """The visit facts, read back if they were written."""
    if frames.visits is not None:
        return frames.visits
    return visit_facts(held_transactions(frames.items), frames.once(shared_visits_of))


def customer_outcomes(lines: DataFrame, units: str) -> DataFrame:
    """Units, spend and visits per customer, before ("pre") and during ("post") the campaign.

    ``units`` is ``"item"`` (lines with a product) or ``"basket"`` (item quantity).
    """
    amount = F.when(F.col("prod_code").isNotNull(), 1) if units == "item" else F.col("basket_item_qty")
    spans = {"pre": F.col("in_pre"), "post": F.col("in_dur")}
    per_visit, per_customer = [], []
    for name, inside in spans.items():
        per_visit += [
            F.sum(F.when(inside, amount)).alias(f"{name}_units"),
            F.sum(F.when(inside, F.col("spend"))).alias(f"{name}_spend"),
            F.bool_or(inside).alias(f"{name}_visit"),
        ]
        visited = F.col(f"{name}_visit") & F.col("transaction_fid").isNotNull()
        per_customer += [
            F.coalesce(F.sum(f"{name}_units"), F.lit(0)).alias(f"{name}_units"),
            F.coalesce(F.sum(f"{name}_spend"), F.lit(0)).alias(f"{name}_spend"),
            F.count_if(visited).alias(f"{name}_visits"),
        ]
    inside = reduce(lambda a, b: a | b, spans.values())
    visits = lines.filter(inside).groupBy("id", "transaction_fid").agg(*per_visit)
    return visits.groupBy("id").agg(*per_customer)


def uplift_panel(panel: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every panel customer with outcomes, 0 where there were none; arm 1 is test."""
    joined = panel.withColumn("event_control_flag", panel_arm("event_control_flag")).join(
        outcomes, "id", "left"
    )
    return joined.na.fill(0, [name for name in outcomes.columns if name != "id"])
