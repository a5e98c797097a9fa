"""Facts of a log besides its features: vehicle, parameters, duration, timeline. Messages are (log_id, seq, time_us, msg_type, fields)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import number

# Kinds of vehicle by a word of the boot text, and by the parameters they alone have, in order.
BOOT_WORDS = {"copter": "Copter", "plane": "Plane", "rover": "Rover", "sub": "Sub"}
PARAMETERS = [("FRAME_CLASS", "Copter"), ("SKID_STEER_OUT", "Rover"), ("CRUISE_SPEED", "Rover"), ("Q_ENABLE", "Plane"), ("SURFACE_DEPTH", "Sub"), ("WPNAV_SPEED_DN", "Sub")]
# Families that two kinds of vehicle are not asked for.
LEFT_OUT = {"Rover": ["vibration", "motors", "control", "spectrum"], "Sub": ["gps", "motors", "control", "spectrum"]}
# How an error shows on the timeline, by the code of its subsystem.
ERROR_EVENTS = {3: ("Compass Error", "critical"), 5: ("Radio Failsafe", "critical"), 6: ("Battery Failsafe", "critical"), 11: ("GPS Glitch", "warning"), 12: ("Crash Detected", "crash"), 16: ("EKF Check Failed", "critical"), 17: ("EKF Failsafe", "crash"), 25: ("Thrust Loss", "critical"), 29: ("Vibration Failsafe", "critical")}


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def timed(messages: DataFrame) -> DataFrame:
    """time_us, or the field `_timestamp`, or 0."""
    return messages.withColumn("time_us", F.coalesce("time_us", _field("_timestamp").try_cast("bigint"), F.lit(0).cast("bigint")))


def parameters(messages: DataFrame) -> DataFrame:
    """The last value of each parameter of a log: log_id, name, value."""
    own = messages.where("msg_type = 'PARM'").select("log_id", "seq", _field("Name").alias("name"), number(_field("Value")).alias("value"))
    return own.groupBy("log_id", "name").agg(F.max_by("value", "seq").alias("value"))


def facts(messages: DataFrame, families: int = 3) -> DataFrame:
    """One row per log: n (messages), families, duration (s, in file order, 0 if not positive), vehicle, version, extracted.

    The vehicle is told by the last boot text that names one, else by parameters. A log without duration and with
    fewer than `families` kinds of messages counts as not extracted.
    """
    text = F.when(F.col("msg_type") == "MSG", F.coalesce(_field("Message"), F.lit("")))
    kind = F.coalesce(*[F.when(F.lower(text).contains(word), name) for word, name in BOOT_WORDS.items()])
    words = F.split(text, " +")
    boot = F.struct(kind.alias("vehicle"), F.when(F.lower(words[0]).rlike("|".join(BOOT_WORDS)), F.try_element_at(words, F.lit(2))).alias("version"))
    has = lambda name: F.max(F.coalesce((F.col("msg_type") == "PARM") & (_field("Name") == name), F.lit(False)))
    own = messages.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("msg_type").alias("families"), F.max_by("time_us", F.when(F.col("time_us").isNotNull(), F.col("seq"))).alias("_z"), F.min_by("time_us", F.when(F.col("time_us").isNotNull(), F.col("seq"))).alias("_a"),
        F.max_by(boot, F.when(kind.isNotNull(), F.col("seq"))).alias("_boot"), *[has(name).alias(f"_{name}") for name, _ in PARAMETERS])
    by_parameter = F.coalesce(*[F.when(F.col(f"_{name}"), kind_) for name, kind_ in PARAMETERS], F.lit("Unknown"))
    duration = F.greatest(F.coalesce((F.col("_z") - F.col("_a")) / 1e6, F.lit(0.0)), F.lit(0.0))
    out = own.select("log_id", "n", "families", duration.alias("duration"), F.coalesce("_boot.vehicle", by_parameter).alias("vehicle"), F.col("_boot.version").alias("version"))
    return out.withColumn("extracted", ~((F.col("duration") == 0) & (F.col("families") < families)))


def message_counts(messages: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Per log: n (its messages), counts (by family). With `families` only those are in the counts; n is of all."""
    each = messages.groupBy("log_id", "msg_type").agg(F.count(F.lit(1)).alias("n"))
    kept = F.lit(True) if families is None else F.col("msg_type").isin(families)
    return each.groupBy("log_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.when(kept & F.col("msg_type").isNotNull(), F.struct("msg_type", "n"))))).alias("counts"))


def routed_features(features: DataFrame, vehicle: str, columns: dict[str, list[str]]) -> DataFrame:
    """features with 0 in the columns of families that the log's vehicle is not asked for; columns: of each family."""
    made = {}
    for family, names in columns.items():
        kinds = [k for k, left in LEFT_OUT.items() if family in left]
        if kinds:
            gone = F.coalesce(F.col(vehicle), F.lit("")).isin(kinds)
            made |= {c: F.when(gone, F.lit(0.0)).otherwise(F.col(c)) for c in names}
    return features.withColumns(made)


def rescaled(df: DataFrame, key: str, column: str, limit: float, by: float = 100.0) -> DataFrame:
    """column divided by `by` in logs in which it goes beyond limit: they have it in another unit."""
    top = df.groupBy(key).agg(F.max(column).alias("_top"))
    return df.join(top, key, "left").withColumn(column, F.when(F.col("_top") > limit, F.col(column) / by).otherwise(F.col(column))).drop("_top")


def origins(messages: DataFrame) -> DataFrame:
    """Per log: origin (time of its first VIBE, else GPS, else ERR, MODE, EV) and end (of its last VIBE, else GPS, else any)."""
    def pick(fn, kinds: list[str]) -> Column:
        return F.coalesce(*[fn("time_us", F.when((F.col("msg_type") == k) & F.col("time_us").isNotNull(), F.col("seq"))) for k in kinds])

    return messages.groupBy("log_id").agg(pick(F.min_by, ["VIBE", "GPS", "ERR", "MODE", "EV"]).alias("origin"), F.coalesce(pick(F.max_by, ["VIBE", "GPS"]), F.max("time_us")).alias("end"))


def timeline(messages: DataFrame, spike: float = 30.0) -> DataFrame:
    """Events of each log in order: log_id, place, t (s since the origin), kind (error, mode, vibe_spike, end), label, severity."""
    base = messages.where("time_us is not null").join(origins(messages).where("origin is not null"), "log_id")
    t = lambda time: F.round((F.col(time) - F.col("origin")) / 1e6, 2).alias("t")
    code = number(_field("Subsys")).cast("int")
    named = {k: F.try_element_at(F.create_map(*[F.lit(x) for c, v in ERROR_EVENTS.items() for x in (c, v[k])]), code) for k in (0, 1)}
    rows = lambda df, kind, label, severity, time="time_us", seq=F.col("seq"): df.select("log_id", t(time), F.lit(kind).alias("kind"), label.alias("label"), severity.alias("severity"), seq.cast("bigint").alias("seq"))
    errors = rows(base.where("msg_type = 'ERR'"), "error", F.coalesce(named[0], F.lit("Error")), F.coalesce(named[1], F.lit("warning")))
    reason = number(_field("Reason"))
    modes = rows(base.where("msg_type = 'MODE'"), "mode", F.concat(F.lit("Mode "), F.coalesce(_field("Mode"), F.lit("Unknown"))), F.when(reason != 0, "warning").otherwise("normal"))
    strong = base.where((F.col("msg_type") == "VIBE") & (number(_field("VibeZ")) > spike))
    first = strong.groupBy("log_id", "origin").agg(F.min_by("time_us", "seq").alias("time_us"), F.min("seq").alias("seq"))
    spikes = rows(first, "vibe_spike", F.lit("Vibration Spike"), F.lit("warning"))
    ends = base.select("log_id", "origin", "end").distinct()
    end = rows(ends, "end", F.lit("Log End"), F.lit("crash"), "end", F.lit(1 << 62))
    every = errors.unionByName(modes).unionByName(spikes).unionByName(end)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("log_id").orderBy("t", "seq", "kind"))).drop("seq")
