"""Radar gates: columns of tilts, rotation, debris, motion and storm cells.

Gates are rows (volume, sweep, elev, az, gate, range_km, ...); every operator
works within a volume, so volumes spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions import wind as W
from cumula.operators.components import connected
from cumula.operators.dealias import dealias_sweeps as dealias_sweeps

VOLUME = ["volume"]


def explode_gates(radials: DataFrame) -> DataFrame:
    """Gates of radials (…, first_gate_m, gate_size_m, data): gate, range_km, value."""
    keep = [c for c in radials.columns if c not in ("data", "first_gate_m", "gate_size_m")]
    g = radials.select(*keep, "first_gate_m", "gate_size_m", F.posexplode("data").alias("gate", "value"))
    return g.select(*keep, "gate", ((F.col("first_gate_m") + F.col("gate") * F.col("gate_size_m")) / 1000.0).alias("range_km"), "value")


def vil(gates: DataFrame) -> DataFrame:
    """Vertically integrated liquid of each place: layers between tilts, capped at 80; one tilt alone gives 0."""
    w = Win.partitionBy(*VOLUME, "az", "gate").orderBy("elev")
    z, h = F.pow(F.lit(10.0), F.col("dbz") / 10), W.beam_height(F.col("range_km"), F.col("elev"))
    s = gates.where("dbz >= 0").select(*VOLUME, "az", "gate", z.alias("z"), h.alias("h"), F.lead(z).over(w).alias("z1"), F.lead(h).over(w).alias("h1"))
    layer = F.when(F.col("h1") > F.col("h"), 3.44e-6 * F.pow((F.col("z") + F.col("z1")) / 2, F.lit(4.0 / 7.0)) * (F.col("h1") - F.col("h")) * 1000)
    return s.groupBy(*VOLUME, "az", "gate").agg(F.least(F.coalesce(F.sum(layer), F.lit(0.0)), F.lit(80.0)).alias("vil"))


def echo_tops(gates: DataFrame, dbz: float = 18.0) -> DataFrame:
    """Beam height of the highest tilt that reaches the threshold."""
    top = gates.where(F.col("dbz") >= dbz).groupBy(*VOLUME, "az", "gate").agg(F.max("elev").alias("elev"), F.first("range_km").alias("range_km"))
    return top.select(*VOLUME, "az", "gate", W.beam_height(F.col("range_km"), F.col("elev")).alias("top_km"))


def column_composite(gates: DataFrame) -> DataFrame:
    return gates.groupBy(*VOLUME, "az", "gate").agg(F.max("dbz").alias("dbz"))


def sweep_mean_wind(gates: DataFrame, near: float = 20.0, far: float = 100.0) -> DataFrame:
    """Range-weighted mean of the wind parts of each sweep."""
    own = gates.where(F.col("vel").isNotNull() & F.col("range_km").between(near, far))
    a, r, v = F.radians("az"), F.col("range_km"), F.col("vel")
    return own.groupBy(*VOLUME, "sweep", "elev").agg((F.sum(v * F.sin(a) * r) / F.sum(r)).alias("u"), (F.sum(v * F.cos(a) * r) / F.sum(r)).alias("v"))


def storm_motion(gates: DataFrame) -> DataFrame:
    """(volume, dir_from, speed_kt): mean of the tilts and 7.5 m/s to the right of the shear between its outer thirds.

    With fewer than three tilts, or hardly any shear, the lowest tilt's wind.
    """
    m = sweep_mean_wind(gates)
    w = Win.partitionBy(*VOLUME).orderBy("elev")
    m = m.select(*VOLUME, "u", "v", F.row_number().over(w).alias("i"), F.count("*").over(Win.partitionBy(*VOLUME)).alias("n"))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    low, high = F.col("i") <= third, F.col("i") > F.col("n") - third
    g = m.groupBy(*VOLUME).agg(F.max("n").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "uv"), *(F.avg(F.when(low, F.col(c))).alias(f"l{c}") for c in "uv"), *(F.avg(F.when(high, F.col(c))).alias(f"h{c}") for c in "uv"), *(F.max(F.when(F.col("i") == 1, F.col(c))).alias(f"f{c}") for c in "uv"))
    su, sv = F.col("hu") - F.col("lu"), F.col("hv") - F.col("lv")
    s = F.sqrt(su * su + sv * sv)
    deviate = (F.col("n") >= 3) & (s > 0.5)
    u = F.when(deviate, F.col("mu") + 7.5 * F.try_divide(sv, s)).otherwise(F.col("fu"))
    v = F.when(deviate, F.col("mv") - 7.5 * F.try_divide(su, s)).otherwise(F.col("fv"))
    g = g.select(*VOLUME, u.alias("u"), v.alias("v"))
    return g.select(*VOLUME, F.pmod(F.degrees(F.atan2("u", "v")) + 180, F.lit(360.0)).alias("dir_from"), (F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")) / W.MS_PER_KT).alias("speed_kt"))


def storm_relative(gates: DataFrame, motion: DataFrame) -> DataFrame:
    """``gates`` with the velocity relative to the volume's storm motion."""
    return gates.join(motion, VOLUME).withColumn("srv", W.storm_relative(F.col("vel"), F.col("az"), F.col("dir_from"), F.col("speed_kt"))).drop("dir_from", "speed_kt")


def shear_candidates(gates: DataFrame, nyquist: float = 30.0, max_gap: float = 3.0, max_range: float = 150.0) -> DataFrame:
    """Neighbouring radials of a sweep, around the circle, that differ strongly at one gate."""
    own = gates.where(F.col("vel").isNotNull() & (F.col("range_km") <= max_range)).select(*VOLUME, "sweep", "elev", "gate", "range_km", "az", "vel")
    wrapped = own.unionByName(own.where(F.col("az") < max_gap + 1).withColumn("az", F.col("az") + 360))
    w = Win.partitionBy(*VOLUME, "sweep", "gate").orderBy("az")
    p = wrapped.select("*", F.lead("az").over(w).alias("az1"), F.lead("vel").over(w).alias("vel1")).where((F.col("az") < 360) & (F.col("az1") - F.col("az") <= max_gap))
    dv = W.dealias_delta(F.col("vel1") - F.col("vel"), F.lit(nyquist))
    arc = F.col("range_km") * 1000 * F.radians(F.col("az1") - F.col("az"))
    p = p.withColumn("dv", F.abs(dv)).withColumn("sense", F.signum(dv)).withColumn("shear", F.try_divide(F.col("dv"), arc))
    return p.where("(abs(vel) >= 1 or abs(vel1) >= 1) and dv >= 10 and shear >= 0.004").select(*VOLUME, "sweep", "elev", "gate", "range_km", "az", "dv", "shear", "sense")


def candidate_components(candidates: DataFrame, az_step: float, reach: int = 2) -> DataFrame:
    """Candidates of a sweep with the label of their group: neighbours within ``reach`` radials and gates."""
    c = candidates.withColumn("id", F.round(F.col("az") / az_step).cast("long") * 10_000 + F.col("gate"))
    turns = round(360 / az_step)
    steps = F.inline(F.array(*(F.struct(F.lit(a).alias("da"), F.lit(b).alias("dg")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a, b) != (0, 0))))
    asked = c.select(*VOLUME, "sweep", F.col("id").alias("a"), "gate", F.round(F.col("az") / az_step).cast("long").alias("r"), steps)
    asked = asked.select(*VOLUME, "sweep", "a", (F.pmod(F.col("r") + F.col("da"), F.lit(turns)) * 10_000 + F.col("gate") + F.col("dg")).alias("b"))
    edges = asked.join(c.select(*VOLUME, "sweep", F.col("id").alias("b")), [*VOLUME, "sweep", "b"])
    return c.join(connected(c, edges, [*VOLUME, "sweep"]), [*VOLUME, "sweep", "id"])


def meso_clusters(labelled: DataFrame, least: int = 4) -> DataFrame:
    """Groups of at least ``least`` candidates: centre, greatest shear and difference, sense by vote, diameter in 1 to 20 km."""
    a = F.radians("az")
    g = labelled.groupBy(*VOLUME, "sweep", "elev", "label").agg(
        F.count("*").alias("n"), F.avg(F.sin(a)).alias("s"), F.avg(F.cos(a)).alias("c"), F.avg("range_km").alias("range_km"), F.max("shear").alias("shear"), F.max("dv").alias("dv"), F.sum("sense").alias("vote"),
        (F.max("range_km") - F.min("range_km")).alias("depth"),
    ).where(F.col("n") >= least)
    az = (F.degrees(F.atan2("s", "c")) + 360) % 360  # bit for bit as in SQL: places exactly at a limit of distance hang on the last one
    return g.select(*VOLUME, "sweep", "elev", "label", "n", az.alias("az"), "range_km", "shear", "dv", F.when(F.col("vote") >= 0, "cyclonic").otherwise("anticyclonic").alias("sense"), F.greatest(F.lit(1.0), F.least(F.lit(20.0), F.col("depth"))).alias("diameter_km"), W.rotation_strength(F.col("shear")).alias("strength"))


def tvs_candidates(gates: DataFrame, nyquist: float = 30.0, tilts: int = 3, near: float = 2.0, far: float = 100.0) -> DataFrame:
    """Pairs of gates one to three apart on a radial of the lowest tilts that differ by the threshold of their middle.

    (volume, sweep, elev, az, gate, gap, range_km, dv, shear): ``gate`` is the
    nearer one, ``range_km`` lies half-way and within ``near`` and ``far``, shear is a kilometre's.
    """
    low = F.dense_rank().over(Win.partitionBy(*VOLUME).orderBy("elev"))
    own = gates.where("vel is not null").withColumn("_t", low).where(F.col("_t") <= tilts)
    w = Win.partitionBy(*VOLUME, "sweep", "az").orderBy("gate")
    there = lambda c, k: F.max(c).over(w.rangeBetween(k, k))
    pairs = F.array(*(F.struct(F.lit(k).alias("gap"), there("vel", k).alias("vel1"), there("range_km", k).alias("r1")) for k in (1, 2, 3)))
    p = own.withColumn("_p", pairs).select(*VOLUME, "sweep", "elev", "az", "gate", "vel", F.col("range_km").alias("_r0"), F.inline("_p")).where("vel1 is not null")
    dv = F.abs(W.dealias_delta(F.col("vel1") - F.col("vel"), F.lit(nyquist)))
    p = p.select(*VOLUME, "sweep", "elev", "az", "gate", "gap", ((F.col("_r0") + F.col("r1")) / 2).alias("range_km"), dv.alias("dv"), F.try_divide(dv, F.col("r1") - F.col("_r0")).alias("shear"))
    return p.where(F.col("range_km").between(near, far) & (F.col("dv") >= W.tvs_threshold(F.col("range_km"))))


def high_z_hail(gates: DataFrame) -> DataFrame:
    """Gates of 50 dBZ or more, 3 km up or higher, 5 to 200 km away, above the lowest tilt."""
    low = F.min("elev").over(Win.partitionBy(*VOLUME))
    h = W.beam_height(F.col("range_km"), F.col("elev"))
    return gates.withColumn("_low", low).withColumn("height_km", h).where("dbz >= 50 and height_km >= 3 and range_km between 5 and 200 and elev > _low").drop("_low")


def tbss(gates: DataFrame, core: float = 60.0) -> DataFrame:
    """Cores with five or more weak gates 8 to 35 km down the radial and a gap below 40 dBZ between."""
    w = Win.partitionBy(*VOLUME, "sweep", "az").orderBy("range_km")
    flare, gap = w.rangeBetween(8, 35), w.rangeBetween(Win.currentRow + 1, 8)
    weak = F.count(F.when(F.col("dbz").between(10, 30), 1)).over(flare)
    own = gates.withColumn("flare", weak).withColumn("gap", F.min("dbz").over(gap))
    return own.where((F.col("dbz") >= core) & (F.col("flare") >= 5) & (F.col("gap") < 40)).select(*VOLUME, "sweep", "az", "gate", "range_km", "dbz", "flare")


def tds_candidates(gates: DataFrame) -> DataFrame:
    """Debris: even gates 15 to 120 km away with strong echo, low ZDR and low correlation, with a score."""
    z, r, c = F.col("dbz"), F.col("zdr"), F.col("cc")
    score = F.greatest(z - 40, F.lit(0.0)) * 0.02 + F.greatest(0.82 - c, F.lit(0.0)) * 2 - F.abs(r) * 0.1
    return gates.where((F.col("gate") % 2 == 0) & F.col("range_km").between(15, 120) & (z >= 40) & (F.abs(r) <= 1.25) & c.between(0.55, 0.82)).withColumn("score", score)


def suppress(candidates: DataFrame, keys: list[str], az_deg: float = 3.0, km: float = 3.0, top: int = 64) -> DataFrame:
    """Best candidates of each key, none within ``az_deg`` and ``km`` of a better one kept; ``top`` at most.

    The fold goes over one key's candidates from the best down; the limit is the product's own.
    """
    s = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "az", "gate", "range_km", "score"))).alias("c"))
    kind = "array<struct<m:double,az:bigint,gate:bigint,range_km:double,score:double>>"

    def keep(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda y: (W.az_diff(y["az"], x["az"]) < az_deg) & (F.abs(y["range_km"] - x["range_km"]) < km))
        return F.when(near | (F.size(acc) >= top), acc).otherwise(F.concat(acc, F.array(x)))

    got = s.select(*keys, F.aggregate(F.col("c").cast(kind), F.array().cast(kind), keep).alias("k"))
    return got.select(*keys, F.posexplode("k").alias("rank", "x")).select(*keys, (F.col("rank") + 1).alias("rank"), "x.az", "x.gate", "x.range_km", "x.score")


def lookup_reflectivity(detections: DataFrame, gates: DataFrame, az_step: float) -> DataFrame:
    """Reflectivity at a detection (volume, det, elev, az, range_km): sweep of nearest elevation, nearest radial, rounded gate.

    Places count to a billionth, so that half-way ones do not hang on the order of a sum.
    """
    g = gates.select(*VOLUME, F.col("elev").alias("g_elev"), F.col("az").alias("g_az"), F.col("gate").alias("g_gate"), "dbz")
    first = gates.groupBy(*VOLUME).agg(F.min("range_km").alias("r0"), F.min("gate").alias("gate0"))
    d = detections.join(first, VOLUME).withColumn("g_gate", F.round(F.round(F.col("range_km") - F.col("r0"), 9)).cast("long") + F.col("gate0")).withColumn("g_az", F.pmod(F.round(F.round("az", 9) / az_step).cast("long") * int(az_step), F.lit(360)))
    j = d.join(g, [*VOLUME, "g_az", "g_gate"], "left")
    w = Win.partitionBy(*VOLUME, "det").orderBy(F.abs(F.col("g_elev") - F.col("elev")).asc_nulls_last(), "g_elev")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*detections.columns, "dbz")


def keep_strongest(detections: DataFrame, keys: list[str], az_deg: float, km: float, by: str) -> DataFrame:
    """Single-link clusters of detections (keys, id, az, range_km), the strongest of each kept, with the cluster's size."""
    turns = int(360 // az_deg)
    own = detections.select(*keys, "id", "az", "range_km", F.floor(F.col("az") / az_deg).alias("_ba"), F.floor(F.col("range_km") / km).alias("_br"))
    steps = F.inline(F.array(*(F.struct(F.lit(a).alias("_da"), F.lit(b).alias("_db")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    other = own.select(*keys, F.col("id").alias("b"), F.col("az").alias("az2"), F.col("range_km").alias("r2"), "_ba", "_br", steps).withColumns({"_ba": F.pmod(F.col("_ba") + F.col("_da"), F.lit(turns)), "_br": F.col("_br") + F.col("_db")}).drop("_da", "_db")
    edges = own.join(other, [*keys, "_ba", "_br"]).where((F.col("id") < F.col("b")) & (W.az_diff(F.col("az"), F.col("az2")) < az_deg) & (F.abs(F.col("range_km") - F.col("r2")) < km)).select(*keys, F.col("id").alias("a"), "b").distinct()
    labelled = detections.join(connected(detections, edges, keys), [*keys, "id"])
    w = Win.partitionBy(*keys, "label")
    return labelled.select("*", F.count("*").over(w).alias("members"), F.row_number().over(w.orderBy(F.desc(by), "id")).alias("_r")).where("_r = 1").drop("_r")


def storm_cores(gates: DataFrame, dbz: float, az_step: float, least: int, reach_gates: int = 3, near: float = 10.0, far: float = 230.0) -> DataFrame:
    """Cells of one threshold on the lowest sweep: groups of gates with centres weighted by squared dBZ.

    Gates within ``reach_gates`` and one radial step are one group; beyond 150 km
    twice as many gates are needed.
    """
    lowest = F.min("elev").over(Win.partitionBy(*VOLUME))
    c = gates.withColumn("_l", lowest).where((F.col("elev") == F.col("_l")) & (F.col("dbz") >= dbz) & F.col("range_km").between(near, far)).withColumn("id", (F.col("az") / az_step).cast("long") * 10_000 + F.col("gate"))
    turns = round(360 / az_step)
    steps = F.inline(F.array(*(F.struct(F.lit(a).alias("da"), F.lit(b).alias("dg")) for a in (-1, 0, 1) for b in range(-reach_gates, reach_gates + 1) if (a, b) != (0, 0))))
    asked = c.select(*VOLUME, F.col("id").alias("a"), "gate", (F.col("az") / az_step).cast("long").alias("r"), steps)
    asked = asked.select(*VOLUME, "a", (F.pmod(F.col("r") + F.col("da"), F.lit(turns)) * 10_000 + F.col("gate") + F.col("dg")).alias("b"))
    edges = asked.join(c.select(*VOLUME, F.col("id").alias("b")), [*VOLUME, "b"])
    m = c.join(connected(c, edges, VOLUME), [*VOLUME, "id"]).withColumn("_w", F.col("dbz") * F.col("dbz"))
    a = F.radians("az")
    g = m.groupBy(*VOLUME, "label").agg(F.count("*").alias("gates"), F.max("dbz").alias("max_dbz"), F.avg("dbz").alias("mean_dbz"), (F.sum(F.col("range_km") * F.col("_w")) / F.sum("_w")).alias("range_km"), F.pmod(F.degrees(F.atan2(F.sum(F.sin(a) * F.col("_w")), F.sum(F.cos(a) * F.col("_w")))), F.lit(360.0)).alias("az"), (F.max("range_km") - F.min("range_km")).alias("depth_km"))
    g = g.where(F.col("gates") >= F.when(F.col("range_km") > 150, 2 * least).otherwise(least))
    return g.withColumn("rank", F.row_number().over(Win.partitionBy(*VOLUME).orderBy(F.desc("max_dbz"), "label")))


def tvs_detections(gates: DataFrame, az_step: float, nyquist: float = 30.0, tilts: int = 3, least_dbz: float = 30.0, near: float = 2.0, far: float = 100.0) -> DataFrame:
    """(volume, det, sweep, elev, az, gate, gap, range_km, dv, shear, kind): gate-to-gate differences over the threshold of their range.

    ``azimuthal`` compares one gate on neighbouring radials around the circle,
    half-way between which it lies; ``radial`` gates up to three apart on one
    radial; only the lowest tilts, ``near`` to ``far`` km, and only where the nearest
    sweep's echo reaches ``least_dbz``. Shear is a kilometre's.
    """
    low = F.dense_rank().over(Win.partitionBy(*VOLUME).orderBy("elev"))
    own = gates.where(F.col("vel").isNotNull()).withColumn("_t", low).where((F.col("_t") <= tilts) & F.col("range_km").between(near, far)).drop("_t")
    wrapped = own.unionByName(own.where(F.col("az") < az_step).withColumn("az", F.col("az") + 360))
    w = Win.partitionBy(*VOLUME, "sweep", "gate").orderBy("az")
    dv = F.abs(W.dealias_delta(F.lead("vel").over(w) - F.col("vel"), F.lit(nyquist)))
    turn = F.lead("az").over(w) - F.col("az")
    across = wrapped.withColumns({"dv": F.when(turn <= az_step * 1.5, dv), "_turn": turn}).where(F.col("az") < 360).where(F.col("dv") >= W.tvs_threshold(F.col("range_km")))
    across = across.select(*VOLUME, "sweep", "elev", F.pmod(F.col("az") + F.col("_turn") / 2, F.lit(360.0)).alias("az"), "gate", F.lit(0).alias("gap"), "range_km", "dv", F.try_divide(F.col("dv"), F.col("range_km") * F.radians("_turn")).alias("shear"), F.lit("azimuthal").alias("kind"))
    along = tvs_candidates(gates, nyquist, tilts, near, far).withColumns({"az": F.col("az").cast("double"), "kind": F.lit("radial")})
    both = across.unionByName(along)
    both = both.withColumn("det", F.concat_ws(":", "kind", "sweep", F.col("az").cast("string"), "gate", "gap"))
    return lookup_reflectivity(both.select(*VOLUME, "det", "sweep", "elev", "az", "gate", "gap", "range_km", "dv", "shear", "kind"), gates, az_step).where(F.col("dbz") >= least_dbz).drop("dbz")


def match_tilts(detections: DataFrame, km: float = 10.0) -> DataFrame:
    """(volume, group, tilts, det): detections (volume, det, tilt, az, range_km) of one place on several tilts.

    From the lowest tilt up, a detection joins the first group whose base lies
    under ``km`` away and that has none of its tilt yet, else it opens a group.
    The fold goes over one volume's detections, which are few and bounded by its sweeps.
    """
    x, y = F.col("range_km") * F.sin(F.radians("az")), F.col("range_km") * F.cos(F.radians("az"))
    rows = detections.select(*VOLUME, F.struct(F.col("tilt").cast("int").alias("tilt"), F.col("det").cast("string").alias("det"), x.alias("x"), y.alias("y")).alias("d"))
    packed = rows.groupBy(*VOLUME).agg(F.array_sort(F.collect_list("d")).alias("all"))
    kind = "array<struct<x:double,y:double,tilts:array<int>,dets:array<string>>>"

    def put(acc: Column, d: Column) -> Column:
        fits = lambda g: (F.sqrt((g["x"] - d["x"]) ** 2 + (g["y"] - d["y"]) ** 2) < km) & ~F.array_contains(g["tilts"], d["tilt"])
        at = F.array_position(F.transform(acc, fits), F.lit(True))
        grown = F.transform(acc, lambda g, i: F.when(i + 1 == at, F.struct(g["x"].alias("x"), g["y"].alias("y"), F.concat(g["tilts"], F.array(d["tilt"])).alias("tilts"), F.concat(g["dets"], F.array(d["det"])).alias("dets"))).otherwise(g))
        fresh = F.concat(acc, F.array(F.struct(d["x"].alias("x"), d["y"].alias("y"), F.array(d["tilt"]).alias("tilts"), F.array(d["det"]).alias("dets"))))
        return F.when(at > 0, grown).otherwise(fresh).cast(kind)

    folded = packed.select(*VOLUME, F.posexplode(F.aggregate("all", F.array().cast(kind), put)).alias("group", "g"))
    return folded.select(*VOLUME, "group", F.size("g.tilts").alias("tilts"), F.explode("g.dets").alias("det"))


def tilt_rotations(gates: DataFrame, az_step: float, least: int = 4, lowest: int = 4, least_dbz: float = 20.0) -> DataFrame:
    """Rotation clusters (volume, det, sweep, tilt, elev, az, range_km, shear, dv, sense, diameter_km, strength) of the lowest tilts with echo at their centre.

    A volume that has no reflectivity at all keeps its clusters.
    """
    low = F.dense_rank().over(Win.partitionBy(*VOLUME).orderBy("elev"))
    own = gates.withColumn("tilt", low).where(F.col("tilt") <= lowest)
    tilt = own.select(*VOLUME, "sweep", "tilt").distinct()
    c = meso_clusters(candidate_components(shear_candidates(own.drop("tilt"), max_gap=az_step), az_step), least)
    named = c.withColumn("det", F.concat_ws(":", "sweep", "label")).join(tilt, [*VOLUME, "sweep"])
    echoes = gates.groupBy(*VOLUME).agg(F.count("dbz").alias("_echoes"))
    seen = lookup_reflectivity(named, gates, az_step).join(echoes, VOLUME)
    return seen.where((F.col("dbz") >= least_dbz) | (F.col("_echoes") == 0)).drop("dbz", "_echoes")


def mesocyclone_detections(rotations: DataFrame, least_tilts: int = 2, km: float = 10.0) -> DataFrame:
    """One row for each rotation of ``tilt_rotations`` found on ``least_tilts`` tilts or more of one place.

    Place and base height (of the beam) are the lowest tilt's, shear, difference,
    strength, sense and diameter those of the tilt with the greatest shear.
    """
    groups = match_tilts(rotations.select(*VOLUME, "det", "tilt", "az", "range_km"), km).where(F.col("tilts") >= least_tilts)
    m = rotations.join(groups, [*VOLUME, "det"])
    low = F.min(F.struct("tilt", "det", "az", "range_km", "elev"))
    best = F.min(F.struct((-F.col("shear")).alias("s"), "tilt", "det", "shear", "dv", "strength", "sense", "diameter_km"))
    g = m.groupBy(*VOLUME, "group", "tilts").agg(low.alias("l"), best.alias("b"))
    return g.select(*VOLUME, "tilts", F.col("l.det").alias("det"), "l.az", "l.range_km", "b.shear", "b.dv", "b.strength", "b.sense", "b.diameter_km", W.beam_height(F.col("l.range_km"), F.col("l.elev")).alias("base_km"))


def mesocyclone_tilts(gates: DataFrame, az_step: float, least_tilts: int = 2, lowest: int = 4, least_dbz: float = 20.0, least: int = 4, km: float = 10.0) -> DataFrame:
    """Rotation found on two tilts or more of one place, one row a detection."""
    return mesocyclone_detections(tilt_rotations(gates, az_step, least, lowest, least_dbz), least_tilts, km)


def associate(detections: DataFrame, cells: DataFrame, km: float) -> DataFrame:
    """Detections (volume, det, az, range_km) with the rank of the nearest storm cell within ``km``, else 0."""
    x = lambda az, r: r * F.sin(F.radians(az))
    y = lambda az, r: r * F.cos(F.radians(az))
    c = cells.select(*VOLUME, F.col("rank").alias("cell"), x("az", F.col("range_km")).alias("cx"), y("az", F.col("range_km")).alias("cy"))
    d = detections.withColumns({"_x": x("az", F.col("range_km")), "_y": y("az", F.col("range_km"))}).join(c, VOLUME, "left")
    dist = F.sqrt((F.col("_x") - F.col("cx")) ** 2 + (F.col("_y") - F.col("cy")) ** 2)
    best = d.groupBy(*detections.columns).agg(F.min(F.when(dist <= km, F.struct(dist.alias("d"), "cell"))).alias("_b"))
    return best.select(*detections.columns, F.coalesce("_b.cell", F.lit(0)).alias("cell"))


def polar_tensor(gates: DataFrame, gates_per_radial: int) -> DataFrame:
    """Row-major array of the lowest sweep's values by azimuth and gate, gaps null."""
    lowest = F.min("elev").over(Win.partitionBy(*VOLUME))
    own = gates.withColumn("_l", lowest).where((F.col("elev") == F.col("_l")) & (F.col("gate") < gates_per_radial))
    row = own.groupBy(*VOLUME, "az").agg(F.map_from_entries(F.collect_list(F.struct("gate", "dbz"))).alias("m"))
    row = row.select(*VOLUME, "az", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(gates_per_radial - 1).cast("long")), lambda i: F.try_element_at("m", i)).alias("r"))
    t = row.groupBy(*VOLUME).agg(F.array_sort(F.collect_list(F.struct("az", "r"))).alias("s"))
    return t.select(*VOLUME, F.size("s").alias("radials"), F.flatten(F.transform("s", lambda x: x["r"])).alias("data"))


def volume_inventory(gates: DataFrame) -> DataFrame:
    return gates.groupBy(*VOLUME).agg(F.countDistinct("sweep").alias("sweeps"), F.countDistinct("sweep", "az").alias("radials"), F.count("*").alias("gates"), F.count("dbz").alias("with_dbz"), F.count("vel").alias("with_vel"), F.array_join(F.array_sort(F.collect_set(F.format_string("%.1f", "elev"))), ",").alias("elevations"))


def volume_frame(**detections: DataFrame) -> DataFrame:
    """One row for each volume with an array of each kind of detection."""
    out = None
    for name, d in detections.items():
        packed = d.groupBy(*VOLUME).agg(F.array_sort(F.collect_list(F.struct(*(c for c in d.columns if c not in VOLUME)))).alias(name))
        out = packed if out is None else out.join(packed, VOLUME, "full")
    return out
