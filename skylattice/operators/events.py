"""Assembly of events from relational trigger tables, and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whether a search program's phases and series have the opposite sign.  Fixed values of the pipelines.
PHASE_INVERTED = {"pycbc": False, "gstlal_inspiral": True, "gstlal_inspiral_coinc_extractor": True, "gstlal_inspiral_postcohspiir_online": True, "MBTAOnline": True, "sgnl-inspiral": True}


def injection_for_coinc(coinc_event_map: DataFrame, sim_inspiral: DataFrame, coinc_inspiral: DataFrame) -> DataFrame:
    """Distinct injections of all coincidences in one join: (coinc_event_id, simulation_id, longitude, latitude, distance, combined_far, snr)."""
    sim_side = coinc_event_map.where(F.col("table_name") == "sim_inspiral").select("coinc_event_id", F.col("event_id").alias("simulation_id"))
    event_side = coinc_event_map.where(F.col("table_name") == "coinc_event").select("coinc_event_id", F.col("event_id").alias("_coinc"))
    joined = sim_side.join(event_side, "coinc_event_id").join(sim_inspiral, "simulation_id")
    own = coinc_inspiral.select(F.col("coinc_event_id").alias("_coinc"), "combined_far", "snr")
    return joined.join(own, "_coinc").select(F.col("_coinc").alias("coinc_event_id"), "simulation_id", "longitude", "latitude", "distance", "combined_far", "snr").distinct()


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` if every key has one row; an error at run time otherwise."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("expected exactly one row for each key")).cast("boolean"))).drop("_n")


def of_definition(coinc_event: DataFrame, coinc_definer: DataFrame, search: str, kind: int, by: list[str] = []) -> DataFrame:
    """Coincidences of one definition: a semi-join.  ``by``: columns within which identifiers hold, such as a file's path."""
    wanted = coinc_definer.where((F.col("search") == search) & (F.col("search_coinc_type") == kind))
    return coinc_event.join(wanted, ["coinc_def_id", *by], "left_semi")


def invert_phase(program: Column, conventions: dict[str, bool] = PHASE_INVERTED) -> Column:
    """Whether a program's phases are inverted; an unknown program is an error at run time, a missing one isn't inverted.

    ``conventions`` may name further programs.
    """
    known = F.element_at(F.create_map(*[F.lit(x) for pair in conventions.items() for x in pair]), program)
    unknown = F.raise_error(F.concat(F.lit("the phase convention of this program is unknown: "), program)).cast("boolean")
    return F.when(program.isNull(), False).when(known.isNull(), unknown).otherwise(known)


def conjugate(series: Column) -> Column:
    """Negate the imaginary parts of array<struct<re, im>>."""
    return F.transform(series, lambda x: F.struct(x["re"].alias("re"), (-x["im"]).alias("im")))


def assemble(coinc_event: DataFrame, coinc_event_map: DataFrame, sngl_inspiral: DataFrame, process: DataFrame | None = None, time_slide: DataFrame | None = None, snr_series: DataFrame | None = None, psd_files: DataFrame | None = None, conventions: dict[str, bool] = PHASE_INVERTED, by: list[str] = []) -> DataFrame:
    """One row per coincidence with ``singles`` sorted by detector.

    Triggers join inward; process, offset, series and PSD are looked up and may be missing.  A
    missing offset is 0; phase and series are inverted for the programs of the opposite convention.
    ``by``: columns of all tables within which identifiers hold, such as a file's path.
    """
    rows = coinc_event.join(coinc_event_map.where(F.col("table_name") == "sngl_inspiral"), ["coinc_event_id", *by]).join(sngl_inspiral.drop("process_id"), ["event_id", *by])
    program = F.lit(None).cast("string")
    if process is not None:
        rows = rows.join(process.select("process_id", "program", *by), ["process_id", *by], "left")
        program = F.col("program")
    offset = F.lit(0.0)
    if time_slide is not None:
        slides = time_slide.select("time_slide_id", F.col("instrument").alias("ifo"), F.col("offset").alias("_offset"), *by)
        rows = rows.join(slides, ["time_slide_id", "ifo", *by], "left")
        offset = F.coalesce("_offset", F.lit(0.0))
    series = F.lit(None).cast("array<struct<re:double,im:double>>")
    if snr_series is not None:
        rows = rows.join(snr_series.select("event_id", F.col("series").alias("_series"), *by), ["event_id", *by], "left")
        series = F.when(invert_phase(program, conventions), conjugate(F.col("_series"))).otherwise(F.col("_series"))
    psd = F.lit(None).cast("string")
    if psd_files is not None:
        rows = rows.join(psd_files.select("process_id", F.col("value").alias("_psd"), *by), ["process_id", *by], "left")
        psd = F.col("_psd")
    phase = F.when(invert_phase(program, conventions), -F.col("coa_phase")).otherwise(F.col("coa_phase"))
    single = F.struct(F.col("ifo").alias("detector"), F.col("snr"), phase.alias("phase"), (F.col("end") + offset).alias("time"), F.col("end").alias("zerolag_time"), series.alias("snr_series"), psd.alias("psd_file"))
    return rows.groupBy("coinc_event_id", *by).agg(F.array_sort(F.collect_list(single)).alias("singles"))


def exclude_detectors(events: DataFrame, detectors: list[str], raises: bool = True, singles: str = "singles") -> DataFrame:
    """Drop detectors from each event; with ``raises`` an error where none is dropped or none is left."""
    kept = F.filter(singles, lambda s: ~s["detector"].isin(*detectors))
    out = events.withColumn("_kept", kept)
    if raises:
        wrong = F.when(F.size("_kept") == F.size(singles), "disabling these detectors has no effect on an event").when(F.size("_kept") == 0, "disabling these detectors leaves an event without data")
        out = out.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean")))
    return out.withColumn(singles, F.col("_kept")).drop("_kept")


def psd_segments(triggers: DataFrame, segments: DataFrame, time: str = "time", width: float = 4096.0) -> DataFrame:
    """Triggers with the PSD segment [start, end) of their detector that holds their time; null where none does, an error where several do.

    An interval join by bins: segments are dealt to the bins of ``width`` seconds that they touch,
    so it is an equi-join with a filter and no side has to be small.
    """
    before = F.max("end").over(Window.partitionBy("ifo").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.coalesce(before <= F.col("start"), F.lit(True)), True).otherwise(F.raise_error(F.lit("segments of a detector overlap")).cast("boolean"))
    segments = segments.withColumn("_apart", apart).where("_apart").drop("_apart")
    binned = segments.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    t = triggers.withColumn("_bin", F.floor(F.col(time) / width)).withColumn("_row", F.monotonically_increasing_id())
    on = (t["_bin"] == binned["_bin"]) & (t["ifo"] == binned["ifo"]) & (t[time] >= binned["start"]) & (t[time] < binned["end"])
    return t.join(binned, on, "left").select(*[t[c] for c in triggers.columns], *[binned[c] for c in segments.columns if c not in triggers.columns])


def half_slide(number: Column, time: Column, shift: Column) -> Column:
    """Times of a two-detector slide: half of the shift each way."""
    return F.when(number == 0, time - 0.5 * shift).when(number == 1, time + 0.5 * shift).otherwise(time)


def coinc_summary(triggers: DataFrame, keys: list[str], snr: str = "snr", time: str = "time") -> DataFrame:
    """Mean time, network SNR and number of triggers of each coincidence."""
    return triggers.groupBy(*keys).agg(F.avg(time).alias("end_time"), F.sqrt(F.sum(F.col(snr) * F.col(snr))).alias("snr"), F.count(F.lit(1)).alias("n"))


def chirp_mass(m1, m2) -> Column:
    m1, m2 = F.col(m1), F.col(m2)
    return F.pow(m1 * m2, F.lit(0.6)) * F.pow(m1 + m2, F.lit(-0.2))


def detection_cuts(triggers: DataFrame, keys: list[str], snr_threshold: float = 4.0, net_snr_threshold: float = 12.0, min_triggers: int = 2, keep_subthreshold: bool = False, duty_cycle: float = 1.0, seed: int = 0, snr: str = "snr", detector: str = "ifo") -> DataFrame:
    """Triggers of detected events: duty cycle, single and network SNR, number of triggers.

    Whether a detector is up is drawn by a seeded hash of the event's keys and the detector, the same on every run and however rows are dealt.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys, detector), F.lit(1 << 40)) / float(1 << 40)
    up = triggers if duty_cycle >= 1 else triggers.where(draw < duty_cycle)
    loud = up.where(F.col(snr) >= snr_threshold)
    own = (up if keep_subthreshold else loud).groupBy(*keys).agg(F.sqrt(F.sum(F.col(snr) * F.col(snr))).alias("_net"))
    events = loud.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(own, keys).where((F.col("_n") >= min_triggers) & (F.col("_net") >= net_snr_threshold))
    return (up if keep_subthreshold else loud).join(events.select(*keys), keys, "left_semi")


def decisive_snr(snrs: Column, min_triggers: int) -> Column:
    """The k-th largest: the SNR that decides whether ``min_triggers`` detectors see an event."""
    return F.try_element_at(F.sort_array(snrs, False), F.lit(min_triggers))


def decisive_of(triggers: DataFrame, keys: list[str], min_triggers: int, snr: str = "snr") -> DataFrame:
    """(keys, snr): the same for triggers as rows, without gathering a group; null where there are fewer."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(snr)))
    top = triggers.withColumn("_nth", nth).where(F.col("_nth") <= min_triggers)
    return top.groupBy(*keys).agg(F.max(F.when(F.col("_nth") == min_triggers, F.col(snr))).alias(snr))


def between_distances(df: DataFrame, low: float, high: float, distance: str = "distance") -> DataFrame:
    return df.where(F.col(distance).between(low, high))


def subsample(df: DataFrame, n: int, seed: int, *tie: str) -> DataFrame:
    """``n`` rows without replacement, in the order of a seeded hash of ``tie``: the same on every run."""
    return df.orderBy(F.xxhash64(*tie, F.lit(seed)), *tie).limit(n)


def template_of(triggers: DataFrame, bank: DataFrame, index: str = "template_id", position: str = "template") -> DataFrame:
    """Triggers with the columns of their template: the row of ``bank`` at a trigger's index.

    ``bank`` has its rows numbered in ``position``; an index outside the bank is an error, as in an array.
    """
    own = bank.withColumn("_there", F.lit(True)).withColumnRenamed(position, "_position")
    out = triggers.join(own, F.col(index) == F.col("_position"), "left").drop("_position")
    found = F.when(F.coalesce("_there", F.lit(False)), True).otherwise(F.raise_error(F.lit("a trigger names a template outside the bank")).cast("boolean"))
    return out.where(found).drop("_there")


def triggers_by_index(coincs: DataFrame, triggers: DataFrame, keys: list[str] = ["coinc_id"], refs: str = "trigger_ids", ifo: str = "ifo", position: str = "row") -> DataFrame:
    """(keys, ifo, order, trigger columns): each detector's trigger of a coincidence, found by its row number in that detector's table.

    ``coincs`` has ``refs``, an array of structs (ifo, row); a negative row means that the detector has none.
    """
    asked = coincs.select(*keys, F.posexplode(refs).alias("order", "_r")).where("_r.row >= 0")
    asked = asked.select(*keys, "order", F.col("_r.ifo").alias(ifo), F.col("_r.row").alias(position))
    return asked.join(triggers, [ifo, position])


def hdf_events(coincs: DataFrame, triggers: DataFrame, bank: DataFrame, psds: DataFrame, half_slides: bool = True) -> DataFrame:
    """Events of the HDF layout held as tables, one row per coincidence with ``singles`` in the order of detectors.

    ``coincs``: (coinc_id, template_id, timeslide_id, shift, trigger_ids array<struct<ifo,row>>).  ``triggers``: (ifo, row, snr, coa_phase,
    end_time).  ``bank``: (template, mass1, mass2, ...).  ``psds``: (ifo, start, end, segment).  A slide of two detectors shifts each by
    half; a trigger in no segment has a null segment.
    """
    single = triggers_by_index(coincs, triggers)
    single = single.join(coincs.select("coinc_id", "template_id", F.col("timeslide_id").alias("_slide"), F.col("shift").alias("_shift")), "coinc_id")
    moved = half_slide(F.col("order"), F.col("end_time"), F.coalesce(F.col("_slide") * F.col("_shift"), F.lit(0.0))) if half_slides else F.col("end_time")
    single = template_of(single.withColumn("time", moved), bank)
    single = psd_segments(single, psds, "end_time")
    row = F.struct("order", F.col("ifo").alias("detector"), "snr", F.col("coa_phase").alias("phase"), "time", F.col("end_time").alias("zerolag_time"), "segment")
    template = [c for c in bank.columns if c != "template"]
    return single.groupBy("coinc_id", "template_id", *template).agg(F.array_sort(F.collect_list(row)).alias("singles"))
