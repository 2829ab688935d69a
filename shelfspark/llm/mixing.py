"""Problem 9: mix sources to target weights, repeating small sources at most a capped number of times.

Time-varying curriculum: a schedule gives each source's share at some times; between them shares run linearly, and at
every time the shares of all sources add up to 1.  Integrating a source's share gives its cumulative token demand.
Each text (and each of its repeats) covers a stretch of its source's tokens; inverting the demand at the middle of the
stretch gives the position, a training time, and the mix is range-sorted by it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .tokens import DEFAULT_TOKENIZER, count_tokens

#: Texts of a source that are summed up in one task.
BLOCK = 20_000


def default_schedule(targets: DataFrame, turn: float = 0.5) -> DataFrame:
    """(source, time, share) from time 0 to 1: the mix starts evener than the weights and ends steeper.

    Shares start at a blend of the weights and of their square roots, turn being the part of the latter (less where a
    share would end below 0), and end such that every source's mean share is its weight.
    """
    rows = targets.where("source is not null and weight is not null and max_repeats is not null").select("source", F.col("weight").cast("double").alias("w"))
    sums = rows.agg(F.sum("w").alias("all"), F.sum(F.sqrt("w")).alias("roots"))
    rows = rows.join(F.broadcast(sums)).select("source", "w", (F.sqrt("w") * F.col("all") / F.col("roots")).alias("even"))  # one row
    most = rows.where("even > w").agg(F.coalesce(F.min(F.col("w") / (F.col("even") - F.col("w"))), F.lit(turn)).alias("most"))
    moved = F.least(F.lit(turn), F.col("most")) * (F.col("even") - F.col("w"))
    ends = F.array(F.struct(F.lit(0.0).alias("time"), (F.col("w") + moved).alias("share")), F.struct(F.lit(1.0).alias("time"), (F.col("w") - moved).alias("share")))
    return rows.join(F.broadcast(most)).select("source", F.explode(ends).alias("x")).select("source", "x.time", "x.share")


def integrated(schedule: DataFrame) -> DataFrame:
    """(source, area, pieces) of each source: its part of the whole demand, and the pieces of its integral.

    schedule: (source, time, share), with the same times for every source and no share below 0.  Shares are divided by
    their sum at each time.  A piece is (before, time, span, share, next): what is demanded before it, when it begins,
    how long it is and the share at both ends.
    """
    at_time = schedule.groupBy("time").agg(F.sum("share").alias("all"))
    rows = schedule.join(F.broadcast(at_time), "time").select("source", "time", F.coalesce(F.try_divide("share", "all"), F.lit(0.0)).alias("share"))  # a row per time of the schedule
    by = Window.partitionBy("source").orderBy("time")  # a row per time
    rows = rows.select("source", "time", "share", (F.lead("time").over(by) - F.col("time")).alias("span"), F.lead("share").over(by).alias("next")).where("span > 0")
    area = F.col("span") * (F.col("share") + F.col("next")) / 2
    rows = rows.select("*", (F.sum(area).over(by) - area).alias("before"), area.alias("area"), F.sum("span").over(Window.partitionBy("source")).alias("length"))
    piece = F.struct("before", "time", "span", "share", "next")
    return rows.groupBy("source").agg((F.sum("area") / F.first("length")).alias("area"), F.sum("area").alias("integral"), F.sort_array(F.collect_list(piece)).alias("pieces"))


def time_of(part: Column) -> Column:
    """The time at which the given part of a source's demand (column pieces and integral) has been met."""
    x = part * F.col("integral")
    piece = F.element_at(F.filter("pieces", lambda p: (p["before"] <= x) | (p["before"] == 0)), -1)
    rest, slope = F.greatest(x - piece["before"], F.lit(0.0)), (piece["next"] - piece["share"]) / piece["span"]
    root = F.sqrt(F.greatest(piece["share"] * piece["share"] + 2 * slope * rest, F.lit(0.0)))
    return piece["time"] + F.least(piece["span"], F.coalesce(F.try_divide(2 * rest, piece["share"] + root), F.lit(0.0)))


def source_budgets(sized: DataFrame, targets: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """One row per source of targets: weight, max_repeats, own_tokens, demand, exhausted_at, reachable.

    own_tokens counts every row of the source; demand is the integral of the source's share times the tokens of all
    sources of targets.  exhausted_at is the time at which the cumulative demand has used max_repeats * own_tokens, null
    if it never does; such a source is reachable.  A source without documents has 0 tokens.  Targets without a source,
    weight or max_repeats are left out; no documents make every demand 0.
    """
    wanted = targets.where("source is not null and weight is not null and max_repeats is not null").select("source", "weight", "max_repeats")
    own = sized.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"))
    rows = wanted.join(own, "source", "left").na.fill(0, ["own_tokens"])
    total = rows.agg(F.sum("own_tokens").alias("total_tokens"))
    rows = rows.join(F.broadcast(integrated(schedule if schedule is not None else default_schedule(targets))), "source", "left")  # a row per source
    rows = rows.join(F.broadcast(total)).withColumn("demand", F.coalesce("area", F.lit(0.0)) * F.col("total_tokens"))  # one row
    cap = F.col("max_repeats") * F.col("own_tokens")
    # the integral's last digit may be off: demands that equal the cap but for it are met
    short = F.col("demand") * (1 - 1e-12) > cap
    return rows.select("source", "weight", "max_repeats", "own_tokens", "demand", F.when(short, time_of(cap / F.col("demand"))).alias("exhausted_at"), (~short).alias("reachable"), "integral", "pieces")


def sized_documents(documents: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source, text_hash, n_tokens) of every row with a doc_id."""
    rows = documents.where("doc_id is not null")
    keyed = rows.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "text")
    # the counts come back beside the key alone; source and hash as parts of the key spare a join
    packed = keyed.select(F.struct("doc_id", "source", "text_hash").alias("doc_id"), "text")
    return count_tokens(packed, path).select("doc_id.doc_id", "doc_id.source", "doc_id.text_hash", "n_tokens")


def laid_out(units: DataFrame, key: str) -> DataFrame:
    """units with upto and all_tokens: the tokens of a key's units up to each one's end, in a hashed order, and of all.

    units: key, text_hash, n_tokens and any others.
    """
    units = units.withColumn("order", F.xxhash64("text_hash"))
    # blocks are the leading bits of the hashed order, as many as the key's texts need
    bits = units.groupBy(key).agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK))).cast("int").alias("bits"))
    units = units.join(bits, key).withColumn("block", F.expr("if(bits = 0, 0L, shiftrightunsigned(`order`, 64 - bits))"))
    blocks = units.groupBy(key, "block").agg(F.sum("n_tokens").alias("block_tokens"))
    by_key = Window.partitionBy(key)
    blocks = blocks.select(
        key, "block",
        (F.sum("block_tokens").over(by_key.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("before"),
        F.sum("block_tokens").over(by_key).alias("all_tokens"),
    )
    # order with its sign bit flipped follows the unsigned order of the blocks
    inside = Window.partitionBy(key, "block").orderBy(F.col("order").bitwiseXOR(F.lit(-(1 << 63))), "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = units.withColumn("inside", F.sum("n_tokens").over(inside)).join(blocks, [key, "block"])
    return placed.withColumn("upto", F.col("before") + F.col("inside")).drop("order", "bits", "block", "before", "inside")


def allotted(pools: list[tuple[list[str], float]], wanted: dict[str, float], own: dict[str, float]) -> list[list[float]]:
    """What part of each pool (its sources, its tokens) each of its sources gets.

    With its own tokens, each source is to have as large a part of what it wants as those it shares with.  The parts of
    a pool whose sources want nothing are 0.  Pools are shared in proportion to factors of the sources, which are mended
    until no part moves.
    """
    factor = {s: 1.0 for s, x in wanted.items() if x > 0}
    parts: list[list[float]] = []
    while True:
        sums = [sum(factor.get(s, 0.0) for s in sources) for sources, _ in pools]
        new = [[factor.get(s, 0.0) / total if total else 0.0 for s in sources] for (sources, _), total in zip(pools, sums)]
        if parts and all(abs(x - y) <= 1e-7 for p, q in zip(parts, new) for x, y in zip(p, q)):
            return new
        parts, has = new, {s: own.get(s, 0.0) for s in factor}
        for (sources, tokens), shares in zip(pools, new):
            for s, x in zip(sources, shares):
                if s in has:
                    has[s] += x * tokens
        factor = {s: x * wanted[s] / has[s] if has[s] else x for s, x in factor.items()}
        most = max(factor.values(), default=1.0)
        factor = {s: x / most for s, x in factor.items()}


def units_of(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, text_hash, doc_id, n_tokens): each distinct text with tokens once, given to one of its sources.

    A text that only one source of budgets has is that source's, named by its smallest doc_id there.  The texts that the
    same sources have are dealt among them such that all come as near to their demand, see allotted; if these have no
    demand, the source of the smallest doc_id has them.
    """
    spark = sized.sparkSession
    rows = sized.where("n_tokens > 0").join(F.broadcast(budgets.select("source").distinct()), "source", "left_semi")  # a row per source
    each = rows.groupBy("text_hash", "source").agg(F.min_by(F.struct("doc_id", "n_tokens"), "doc_id").alias("u")).select("text_hash", "source", "u.*")
    # a text has as many holders as sources have it
    texts = stage(each.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id", "n_tokens"))).alias("holders")), "texts")
    alone = texts.where(F.size("holders") == 1).select("text_hash", F.col("holders")[0].alias("u")).select("u.source", "text_hash", "u.doc_id", "u.n_tokens")
    shared = texts.where(F.size("holders") > 1).select("text_hash", "holders", F.col("holders.source").alias("sources"), F.col("holders")[0]["n_tokens"].alias("n_tokens"))
    shared = shared.withColumn("pool", F.xxhash64(F.to_json("sources")))
    pools = shared.groupBy("pool").agg(F.first("sources").alias("sources"), F.sum("n_tokens").alias("tokens")).collect()  # a row per set of sources
    if not pools:
        return alone
    own = {r[0]: float(r[1]) for r in alone.groupBy("source").agg(F.sum("n_tokens")).collect()}  # a row per source
    once = F.when(F.col("max_repeats") > 0, F.col("demand") / F.col("max_repeats")).otherwise(0.0)
    wanted = {r[0]: r[1] for r in budgets.select("source", once.cast("double")).collect()}
    parts = allotted([(p["sources"], float(p["tokens"])) for p in pools], wanted, own)
    ends = [(p["pool"], list(itertools.accumulate(x))) for p, x in zip(pools, parts)]
    dealt = laid_out(shared, "pool").join(F.broadcast(spark.createDataFrame(ends, "pool long, ends array<double>")), "pool")
    middle = (F.col("upto") - F.col("n_tokens") / 2) / F.col("all_tokens")
    # the sums of the parts may end a last digit below 1
    first = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.size("ends") - 1), lambda i: F.get("ends", i) >= middle), F.lit(0)), F.array_position("ends", F.array_max("ends")).cast("int") - 1)
    smallest = F.array_min(F.transform("holders", lambda h: F.struct(h["doc_id"].alias("doc_id"), h["source"].alias("source"), h["n_tokens"].alias("n_tokens"))))
    chosen = F.get("holders", first)
    given = F.when(F.array_max("ends") > 0, F.struct(*[chosen[c].alias(c) for c in ("doc_id", "source", "n_tokens")])).otherwise(smallest)
    return alone.unionByName(dealt.select("text_hash", given.alias("u")).select("u.source", "text_hash", "u.doc_id", "u.n_tokens"))


def mixture(sized: DataFrame, targets: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """(position, doc_id, source, pass, n_tokens) sorted by position: the training order of the mix.

    Rows with the same text are one unit, so no text is used more than max_repeats times; units_of says which of its
    sources has a text that several have.  Each source gives whole passes over its units and, in the last pass, the
    units the middle of whose stretch lies within the remainder, until its demand or its cap (max_repeats times its
    units) is met.  A source that its cap keeps below its demand is spread over the whole time.  Texts without tokens
    add nothing to any share and have no position.  schedule: see integrated; default_schedule if none.
    """
    budgets = stage(source_budgets(sized, targets, schedule).select("source", "max_repeats", "demand", "integral", "pieces"), "budgets")
    units = stage(units_of(sized, budgets), "units")
    placed = laid_out(units, "source").join(F.broadcast(budgets), "source")  # a row per source of targets
    budget = F.least(F.col("demand"), F.col("max_repeats") * F.col("all_tokens"))
    passes = F.ceil(budget / F.col("all_tokens")).cast("int")
    copies = placed.withColumn("budget", budget).withColumn("pass", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))))
    middle = (F.col("pass") - 1) * F.col("all_tokens") + F.col("upto") - F.col("n_tokens") / 2
    used = copies.withColumn("middle", middle).where("middle <= budget")
    return used.select(F.round(time_of(F.col("middle") / F.col("budget")), 9).alias("position"), "doc_id", "source", "pass", "n_tokens").orderBy("position", "doc_id", "pass")


def mixing_report(documents: DataFrame, targets: DataFrame, path: str = DEFAULT_TOKENIZER, schedule: DataFrame | None = None) -> DataFrame:
    """One row per source of targets: its budget, the tokens and texts the mix uses, and the share they make.

    own_tokens and reachable count every row, as the problem states; the mix uses each distinct text once a pass, so
    used_tokens of a source with copies may stay below its demand although it is reachable.
    """
    sized = stage(sized_documents(documents, path), "sized")
    used = mixture(sized, targets, schedule).groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_rows"))
    rows = source_budgets(sized, targets, schedule).join(used, "source", "left").na.fill(0, ["used_tokens", "used_rows"])
    total = rows.agg(F.sum("used_tokens").alias("mix_tokens"))
    share = F.round(F.coalesce(F.try_divide("used_tokens", "mix_tokens"), F.lit(0.0)), 6).alias("share")
    return rows.join(F.broadcast(total)).select(  # one row
        "source", "weight", "max_repeats", "own_tokens", F.round("demand", 3).alias("demand"), F.round("exhausted_at", 6).alias("exhausted_at"), "reachable", "used_tokens", "used_rows", share
    )


def unreachable_sources(documents: DataFrame, targets: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The sources whose demand outruns all repeats of their texts at some time: their cap keeps them below their weight."""
    return source_budgets(sized_documents(documents, path), targets).where("exhausted_at is not null").select("source")
