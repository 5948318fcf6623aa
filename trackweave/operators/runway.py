"""Arrivals, runway sequences, reassignment and recovery routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut

from . import geometry as g

NOT_SPECIFIED = "NOT_SPECIFIED"
#: Markers of heavy aircraft.
HEAVY = "B744|B747|B748|B763|B764|B777|B787|A330|A340|A350|A380|HEAVY"
SPACING, HEAVY_SPACING, CAPACITY, OVERLOAD = 120, 180, 36, 0.85
#: Before any eta, in seconds: a runway without an earlier arrival.
EARLIEST = "-1e12D"

e = F.expr


def arrivals(points: DataFrame, tracks: DataFrame, members: DataFrame) -> DataFrame:
    """track_id, cluster_id, load_seq, runway, start, eta, optimal_eta, delay, wake of every clustered track with points."""
    s = g.steps(points)
    agg = s.groupBy("track_id").agg(F.max_by("t", "seq").alias("last_t"), F.coalesce(F.sum(g.norm("dx", "dy", "dz")), F.lit(0.0)).alias("length"), F.median("v").alias("speed"), F.max("n").alias("n"))
    t = tracks.withColumn("rw", F.upper(F.trim(F.coalesce("runwayname", F.lit(""))))).withColumn("runway", F.when(F.col("rw").rlike(r"^\d{1,2}[LRC]?$"), F.col("rw")).otherwise(NOT_SPECIFIED))
    wake = F.when(F.upper(F.concat_ws(" ", F.coalesce("aircraft_category", F.lit("")), F.coalesce("aircrafttype", F.lit("")))).rlike(HEAVY), "heavy").otherwise("medium")
    t = t.select("track_id", "load_seq", "runway", g.seconds_of_day(F.col("trackstart_time")).alias("start"), wake.alias("wake"))
    out = agg.join(t, "track_id").join(members, "track_id").withColumns({"eta": e("start + last_t"), "optimal_eta": e("start + if(n < 2, last_t, length / (greatest(120D, speed) * 1.68781D))")})
    return out.select("track_id", "cluster_id", "load_seq", "runway", "start", "eta", "optimal_eta", F.greatest(F.lit(0.0), F.col("eta") - F.col("optimal_eta")).alias("delay"), "wake")


def _scheduled(rows: DataFrame, key: list[str], width: float) -> DataFrame:
    """``rows`` by eta in each group of ``key``, with number, lead (the row before), required, c, base and top: base + c is the sum of
    the spacings up to a row, top - base the maximum of eta less that sum so far, so c + top is the schedule.

    Sums and maxima are taken inside slots of ``width`` seconds first and then over the slots, of which a group has few, so no task
    orders all rows of a group.  Ties go by load order; rows without an eta come first and have no schedule.
    """
    rows = cut(rows.withColumn("slot", F.coalesce(F.floor(F.col("eta") / width), F.lit(-(2**62)))))
    inside = [*key, "slot"]
    order = Window.partitionBy(*inside).orderBy("eta", "load_seq", "track_id")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = Window.partitionBy(*key).orderBy("slot")
    earlier = slots.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.struct("wake", "eta", "optimal_eta"), F.struct("eta", "load_seq", "track_id"))
    ends = rows.groupBy(*inside).agg(F.count("*").alias("n"), last.alias("last"))
    ends = ends.select(*inside, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.lag("last").over(slots).alias("prior"))
    out = rows.withColumns({"at": F.row_number().over(order), "lead": F.lag(F.struct("wake", "eta", "optimal_eta")).over(order)}).join(ends, inside)
    out = out.withColumns({"number": (F.col("before") + F.col("at")).cast("int"), "lead": e("if(at = 1, prior, lead)")})
    out = out.withColumn("required", e(f"if(lead.wake = 'heavy' and wake != 'heavy', {HEAVY_SPACING}, {SPACING})"))
    out = out.withColumn("c", F.sum(e("if(number = 1, 0, required)")).over(running))
    out = out.withColumn("m", F.max(F.col("eta") - F.col("c")).over(running))
    sums = out.groupBy(*inside).agg(F.max("c").alias("total"), F.max(F.col("eta") - F.col("c")).alias("peak"))
    sums = sums.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    sums = sums.select(*inside, "base", (F.max(F.col("peak") - F.col("base")).over(earlier) + F.col("base")).alias("carried"))
    return out.join(sums, inside).withColumn("top", F.greatest("m", "carried")).drop("slot", "before", "prior", "at", "m", "carried")


def sequence(arrived: DataFrame, width: float = 60.0) -> DataFrame:
    """Order by eta on each specified runway, spacing, risks and the earliest schedule that keeps all spacings.

    The schedule S_i = max(eta_i, S_{i-1} + r_i) is C_i + max over j <= i of (eta_j - C_j), where C sums the spacings.
    """
    out = _scheduled(arrived.where(F.col("runway") != NOT_SPECIFIED), ["runway"], width)
    out = out.withColumns({"spacing": e("eta - lead.eta"), "violation": e("coalesce(eta - lead.eta < required, false)"), "overtaking": e("coalesce(optimal_eta < lead.optimal_eta and eta > lead.eta, false)"), "scheduled": e("c + top")})
    return out.withColumn("sequence_delay", e("greatest(0D, scheduled - eta)")).drop("lead", "c", "base", "top")


def summary(arrived: DataFrame, ordered: DataFrame) -> DataFrame:
    """Counts, landings in the busiest hour, use of the capacity, violations and delays by runway; zeros where not specified."""
    hours = arrived.groupBy("runway", F.floor(F.col("eta") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    base = hours.groupBy("runway").agg(F.sum("n").alias("arrivals"), F.max("n").alias("busiest"))
    seq = ordered.groupBy("runway").agg(F.sum(F.col("violation").cast("long")).alias("violations"), F.sum("delay").alias("total_delay"), F.avg("delay").alias("mean_delay"))
    out = base.join(seq, "runway", "left").fillna(0, ["violations"]).fillna(0.0, ["total_delay", "mean_delay"])
    out = out.withColumn("landings_per_hour", F.when(F.col("runway") == NOT_SPECIFIED, 0).otherwise(F.col("busiest")))
    out = out.withColumn("utilization", e(f"least(1.5D, landings_per_hour / {CAPACITY}D)")).drop("busiest")
    return out.withColumn("overloaded", (F.col("runway") != NOT_SPECIFIED) & (F.col("utilization") >= OVERLOAD))


def parallels(runways: DataFrame) -> DataFrame:
    """(runway, parallel): the first parallel runway that has arrivals, by side: L takes R, C; R takes L, C; C takes L, R."""
    own = runways.select("runway").distinct().where(F.col("runway").rlike(r"^\d{1,2}[LRC]$"))
    split = own.select("runway", F.expr("substring(runway, 1, length(runway) - 1)").alias("no"), F.expr("right(runway, 1)").alias("side"))
    other = split.select(F.col("runway").alias("parallel"), "no", F.col("side").alias("other"))
    rank = F.when(F.concat("side", "other").isin("LR", "RL", "CL"), 1).otherwise(2)
    joined = split.join(other, "no").where("side != other").withColumn("r", rank)
    return joined.groupBy("runway").agg(F.min_by("parallel", "r").alias("parallel"))


def reassignment(arrived: DataFrame, overload: float = OVERLOAD, movable: int = 10, width: float = 60.0) -> DataFrame:
    """For each overloaded runway with a parallel one, the best of all ways to move some of its last ``movable`` arrivals (in load
    order): source, target, moved, moved_count, cost.

    The movable arrivals cut both runways' other arrivals into stretches that are alike in all 2**movable masks.  A stretch entered at
    s is scheduled at C_i + max(M_i, s), where C sums its spacings and M is its own running maximum of eta - C; so a mask needs one
    step a stretch, and the sums of max(M_i, s) are taken once for each stretch and s.  No arrival is copied for a mask.  Arrivals
    without an eta have no place in a schedule and don't move.
    """
    known = arrived.where("eta is not null")
    key, place = F.struct("eta", "load_seq", "track_id"), ["runway", "place"]
    use = summary(arrived, sequence(arrived)).where((F.col("runway") != NOT_SPECIFIED) & (F.col("utilization") >= overload)).select("runway")
    pairs = cut(parallels(arrived).join(use, "runway"))
    src = known.join(pairs, "runway")
    latest = Window.partitionBy("runway").orderBy(F.desc("load_seq"), F.desc("track_id"))
    last = src.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= movable)
    last = cut(last.select("runway", "parallel", (F.col("rank") - 1).alias("bit"), "eta", "load_seq", "track_id", "wake"))
    moves = last.groupBy("runway").agg(F.sort_array(F.collect_list(F.struct("eta", "load_seq", "track_id"))).alias("cuts"))
    stay = src.join(last.select("runway", "track_id"), ["runway", "track_id"], "left_anti").select("runway", F.lit("S").alias("place"), "track_id", "load_seq", "eta", "optimal_eta", "wake")
    target = known.withColumnRenamed("runway", "parallel").join(pairs, "parallel").select("runway", F.lit("T").alias("place"), "track_id", "load_seq", "eta", "optimal_eta", "wake")
    fixed = stay.unionByName(target).join(moves, "runway").withColumn("own", key)
    fixed = fixed.withColumn("at", e("2 * size(filter(cuts, m -> m < own))")).drop("cuts", "own")
    rows = _scheduled(fixed.withColumnRenamed("at", "stretch"), [*place, "stretch"], width).withColumns({"spaced": e("base + c"), "peak": e("top - base")})
    rows = rows.select(*place, "stretch", "spaced", "peak", "eta", "load_seq", "track_id", "wake")
    lone = last.join(moves, "runway").withColumn("own", key).withColumn("stretch", e("2 * array_position(cuts, own) - 1").cast("int"))
    lone = lone.withColumn("place", F.explode(F.array(F.lit("S"), F.lit("T")))).select(*place, "stretch", "bit", F.lit(0).alias("spaced"), F.col("eta").alias("peak"), "eta", "load_seq", "track_id", "wake")
    rows = cut(rows.withColumn("bit", F.lit(None).cast("int")).unionByName(lone))
    stretches = rows.groupBy(*place, "stretch").agg(
        F.max("bit").alias("bit"), F.max("spaced").alias("spaced"), F.max("peak").alias("peak"), F.min_by("wake", key).alias("first"), F.max_by("wake", key).alias("final"), F.sum(F.col("spaced") - F.col("eta")).alias("less"))
    # One walk over the stretches for each mask and runway.
    walks = stretches.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("stretch", "bit", "spaced", "peak", "first", "final"))).alias("walk"))
    size = last.groupBy("runway").agg(F.count("*").alias("k"))
    walks = walks.join(size, "runway").withColumn("mask", F.explode(e("sequence(0, shiftleft(1, cast(k as int)) - 1)")))
    walks = walks.withColumn("walk", e("filter(walk, x -> x.bit is null or (shiftright(mask, x.bit) & 1 = 1) = (place = 'T'))"))
    enter = f"coalesce(a.now + if(a.wake = 'heavy' and x.first != 'heavy', {HEAVY_SPACING}, {SPACING}), {EARLIEST})"
    begin = "named_struct('now', cast(null as double), 'wake', cast(null as string), 'steps', cast(array() as array<struct<stretch: int, s: double>>))"
    step = f"named_struct('now', x.spaced + greatest(x.peak, {enter}), 'wake', x.final, 'steps', array_append(a.steps, named_struct('stretch', x.stretch, 's', {enter})))"
    steps = walks.select(*place, "mask", F.explode(e(f"aggregate(walk, {begin}, (a, x) -> {step}).steps")).alias("step")).select(*place, "mask", "step.*")
    steps = cut(steps)
    # The sum of max(M_i, s) in each stretch for each s: counts of peaks between the values of s, then running sums.
    entries = steps.groupBy(*place, "stretch").agg(F.sort_array(F.collect_set("s")).alias("entries"))
    peaks = rows.groupBy(*place, "stretch", "peak").agg(F.count("*").alias("n")).join(entries, [*place, "stretch"])
    peaks = peaks.withColumn("at", e("size(filter(entries, s -> s <= peak))")).groupBy(*place, "stretch", "at").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("peak")).alias("m"))
    asked = entries.select(*place, "stretch", F.posexplode("entries").alias("at", "s"))
    both = Window.partitionBy(*place, "stretch")
    upto = both.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = asked.select("*", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m")).unionByName(peaks.withColumn("s", F.lit(None).cast("double")))
    sums = sums.withColumns({"below": F.sum("n").over(upto), "rest": F.sum("m").over(both) - F.sum("m").over(upto)}).where("s is not null").select(*place, "stretch", "s", e("s * below + rest").alias("reached"))
    late = steps.join(sums, [*place, "stretch", "s"]).join(stretches.select(*place, "stretch", "less"), [*place, "stretch"]).groupBy("runway", "mask").agg(F.sum(F.col("reached") + F.col("less")).alias("late"))
    # Landings of the target's busiest hour with those that move there.
    hours = target.groupBy("runway", F.floor(F.col("eta") / 3600).alias("h")).agg(F.count("*").alias("n"))
    touched = last.withColumn("h", F.floor(F.col("eta") / 3600)).join(hours, ["runway", "h"], "left").groupBy("runway").agg(F.collect_list(F.struct("bit", "h", F.coalesce("n", F.lit(0)).alias("n"))).alias("touched"))
    most = touched.join(hours.groupBy("runway").agg(F.max("n").alias("busiest")), "runway", "left")
    cost = late.join(most, "runway").withColumn("touched", e("filter(touched, x -> shiftright(mask, x.bit) & 1 = 1)"))
    cost = cost.withColumn("busiest", e("coalesce(greatest(busiest, array_max(transform(touched, x -> x.n + size(filter(touched, y -> y.h = x.h))))), 0)"))
    cost = cost.withColumn("moves", F.bit_count("mask")).withColumn("cost", e(f"late + 45D * moves + 1000D * greatest(0D, least(1.5D, busiest / {CAPACITY}D) - {OVERLOAD}D)"))
    best = cost.groupBy("runway").agg(F.min(F.struct("cost", "moves", "mask")).alias("m"))
    picked = best.join(last, "runway").where("shiftright(m.mask, bit) & 1 = 1")
    return picked.groupBy(F.col("runway").alias("source"), F.col("parallel").alias("target"), F.col("m.cost").alias("cost")).agg(F.sort_array(F.collect_list("track_id")).alias("moved"), F.count("*").alias("moved_count"))


def recovery_routes(points: DataFrame, arrived: DataFrame, ordered: DataFrame, most: int = 20) -> DataFrame:
    """Minimum-jerk coefficients for the first ``most`` arrivals (in cluster and load order) whose spacing is violated."""
    late = arrived.join(ordered.where("violation").select("track_id"), "track_id", "left_semi").orderBy("cluster_id", "load_seq").limit(most)
    return g.minimum_jerk(points.join(late.select("track_id"), "track_id", "left_semi")).join(late.select("track_id", "runway"), "track_id")
