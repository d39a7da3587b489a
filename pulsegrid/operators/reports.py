"""Analysis results as JSON reports, one text a track, by expressions over the result tables.

Field names and the number rule (nine significant digits, null for NaN, +-1e999 for
infinities) are the report schema's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import db, json_number
from pulsegrid.model import ClippingConfig, DcConfig, SilenceConfig
from pulsegrid.operators import clipping, dc, stats
from pulsegrid.operators.analyzers import BeatAnalysis

VERSION = '"1.0.0"'


def number(x: Column | float | int) -> Column:
    return json_number((x if isinstance(x, Column) else F.lit(x)).cast("double"))


def whole(x: Column | int) -> Column:
    return F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("long").cast("string"), F.lit("null"))


def text(x: Column | str) -> Column:
    quoted = F.to_json(F.array((x if isinstance(x, Column) else F.lit(x)).cast("string")))
    return F.expr("null") if x is None else F.coalesce(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("null"))


def flag(x: Column | bool) -> Column:
    return F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("string"), F.lit("null"))


def items(tokens: Column) -> Column:
    """A JSON array of an array of tokens."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(tokens, ","), F.lit("")), F.lit("]"))


def record(fields: dict[str, Column]) -> Column:
    """A JSON object of tokens; a null token is null."""
    parts: list[Column] = []
    for i, (name, token) in enumerate(fields.items()):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), F.coalesce(token, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def numbers(values: Column) -> Column:
    return items(F.transform(values, lambda v: number(v)))


def _listed(rows: DataFrame, key: str, order: list[str], token: Column, name: str) -> DataFrame:
    """(key, name): the rows' tokens as one JSON array in the order."""
    cols = [F.col(c) for c in order]
    g = rows.select(key, F.struct(*cols, token.alias("_token")).alias("_s")).groupBy(key).agg(F.sort_array(F.collect_list("_s")).alias("_l"))
    return g.select(key, items(F.transform("_l", lambda s: s["_token"])).alias(name))


def statistics(samples: DataFrame, sample_rate: int, container: int = 0) -> DataFrame:
    """(track, json): levels, bit depth and histogram of each channel, and the stereo figures of tracks with two.  container is 0 for floats."""
    one = stats.channel_stats(samples, sample_rate)
    dynamic = stats.dynamic_range(samples, sample_rate).select("track", "channel", "dr_db")
    counts = stats.histogram(samples).groupBy("track", "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda s: s["n"].cast("string")).alias("counts"))
    if container:
        depth = stats.bit_depth(samples, container).select("track", "channel", F.col("effective_bits").alias("bits"), "dither_likely", "dither_confidence", F.format_string("%d-bit", "effective_bits").alias("description"))
    else:
        depth = stats.float_grid(samples).select("track", "channel", F.col("grid_bits").alias("bits"), F.lit(False).alias("dither_likely"), F.lit(0.0).alias("dither_confidence"), "description")
    rows = one.join(dynamic, ["track", "channel"], "left").join(counts, ["track", "channel"]).join(depth, ["track", "channel"], "left")
    channel = record({
        "peak": number(F.col("peak")), "peakDbfs": number(F.col("peak_dbfs")), "peakFrame": whole(F.col("peak_frame")), "minValue": number(F.col("min")), "maxValue": number(F.col("max")), "dcOffset": number(F.col("mean")),
        "rms": number(F.col("rms")), "rmsDbfs": number(db(F.col("rms"))), "variance": number(F.col("variance")), "stdDev": number(F.col("std_dev")), "crestFactorDb": number(F.col("crest_db")),
        "zeroCrossingRate": number(F.col("zero_crossing_rate")), "effectiveBitDepth": whole(F.coalesce("bits", F.lit(0))), "containerBitDepth": whole(container), "ditherLikely": flag(F.col("dither_likely")),
        "ditherConfidence": number(F.col("dither_confidence")), "bitDepthDescription": text(F.col("description")), "dynamicRangeDr": number(F.col("dr_db")), "histogram": items(F.col("counts")),
    })
    channels = _listed(rows, "track", ["channel"], channel, "channels")
    whole_track = stats.overall_stats(one).select("track", F.col("channels").alias("n_channels"), "frames", "crest_db").join(dynamic.groupBy("track").agg(F.avg("dr_db").alias("dr_db")), "track", "left")
    series = stats.rms_series(samples, sample_rate).groupBy("track").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "channel", "rms"))), lambda s: s["rms"]).alias("series"))
    pairs = stats.correlation_series(samples, sample_rate).groupBy("track").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "correlation"))), lambda s: s["correlation"]).alias("cs"))
    stereo = stats.stereo_summary(samples).join(pairs, "track", "left")
    stereo = stereo.select("track", record({"correlation": number(F.col("correlation")), "balanceDb": number(F.col("balance_db")), "monoCompatibilityDb": number(F.col("mono_compatibility_db")), "correlationSeries": numbers(F.col("cs"))}).alias("stereo"))
    out = whole_track.join(channels, "track").join(series, "track").join(stereo, "track", "left")
    return out.select("track", record({
        "schemaVersion": F.lit(VERSION), "sampleRate": whole(sample_rate), "channelCount": whole(F.col("n_channels")), "frameCount": whole(F.col("frames")), "crestFactorDb": number(F.col("crest_db")), "dynamicRangeDr": number(F.col("dr_db")),
        "channels": F.col("channels"), "stereo": F.col("stereo"), "rmsSeriesChannelCount": whole(F.col("n_channels")), "rmsSeries": numbers(F.col("series")),
    }).alias("json"))


def silence(found: DataFrame, summary: DataFrame, levels: DataFrame, sample_rate: int, cfg: SilenceConfig, kind: str = "threshold") -> DataFrame:
    """(track, json) from silence.regions, .summary and .levels; a track without silence has an empty list."""
    rows = found.join(levels.select("track", "w_begin", "max_db", "mean_db"), ["track", "w_begin"], "left")
    region = record({
        "beginFrame": whole(F.col("frame_begin")), "endFrame": whole(F.col("frame_end")), "startSeconds": number(F.col("frame_begin") / sample_rate), "endSeconds": number(F.col("frame_end") / sample_rate),
        "kind": text(kind), "position": text(F.col("position")), "peakDbfsWithin": number(F.col("max_db")), "rmsDbfsWithin": number(F.col("mean_db")), "channelMask": whole(F.col("mask")) if "mask" in found.columns else whole(0),
    })
    regions = _listed(rows, "track", ["frame_begin"], region, "regions_json")
    used = record({"thresholdDb": number(cfg.threshold_db), "minDurationMs": number(cfg.min_ms), "mergeGapMs": number(cfg.merge_ms), "channelMode": text(cfg.mode), "useHysteresis": flag(cfg.hysteresis_db > 0), "hysteresisDb": number(cfg.hysteresis_db)})
    return summary.join(regions, "track", "left").select("track", record({
        "schemaVersion": F.lit(VERSION), "leadingSilenceSeconds": number(F.col("leading_s")), "trailingSilenceSeconds": number(F.col("trailing_s")), "totalSilenceSeconds": number(F.col("total_s")), "silenceFraction": number(F.col("fraction")),
        "parametersUsed": used, "regions": F.coalesce("regions_json", F.lit("[]")),
    }).alias("json"))


def clips(samples: DataFrame, sample_rate: int, cfg: ClippingConfig, peaks: DataFrame | None = None) -> DataFrame:
    """(track, json) of clipping.events with inter-sample peaks; the cfg.max_events worst of each track are listed, the counts are of all."""
    found = clipping.with_inter_sample_peaks(clipping.events(samples, cfg), peaks) if peaks is not None else clipping.events(samples, cfg)
    event = record({
        "beginFrame": whole(F.col("begin")), "endFrame": whole(F.col("end")), "startSeconds": number(F.col("begin") / sample_rate), "endSeconds": number(F.col("end") / sample_rate), "channel": whole(F.col("channel")),
        "kind": text(F.col("kind")), "peakValue": number(F.col("peak")), "peakDbfs": number(F.col("peak_dbfs")), "sampleCount": whole(F.col("sample_count")),
    })
    listed = _listed(clipping.worst_of_each(found, cfg.max_events), "track", ["begin", "channel", "kind"], event, "events_json")
    counts = found.groupBy("track").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"c{i}") for i, k in enumerate(clipping.KINDS)])
    flat = clipping.flat_top(samples).groupBy("track").agg(F.max("flat_top_ratio").alias("flat_top"), F.bool_or("heavy_limiting").alias("heavy"))
    plateau = clipping.plateaus(samples).groupBy("track").agg(F.avg("mean_length").alias("plateau"))
    used = record({"ceilingDbfs": number(db(F.lit(clipping.limits(cfg)[0]))), "minRunSamples": whole(cfg.min_run), "nearClipDbfs": number(cfg.near_db), "nearClipMinRun": whole(cfg.near_run), "flatnessToleranceDb": number(cfg.flatness_db), "mergeGapSamples": whole(cfg.merge_gap), "detectInterSamplePeaks": flag(peaks is not None), "maxStoredEvents": whole(cfg.max_events)})
    out = clipping.totals(found, samples).join(counts, "track", "left").join(listed, "track", "left").join(flat, "track", "left").join(plateau, "track", "left")
    return out.select("track", record({
        "schemaVersion": F.lit(VERSION), "totalClippedSamples": whole(F.col("clipped_samples")), "clippedFraction": number(F.col("clipped_fraction")), "maxOvershootDb": number(F.col("max_overshoot_db")), "flatTopRatio": number(F.coalesce("flat_top", F.lit(0.0))),
        "meanPlateauLength": number(F.col("plateau")), "heavyLimitingLikely": flag(F.coalesce("heavy", F.lit(False))), "containerBitDepth": whole(cfg.bit_depth), "eventCount": items(F.array(*[whole(F.coalesce(f"c{i}", F.lit(0))) for i in range(len(clipping.KINDS))])),
        "parametersUsed": used, "events": F.coalesce("events_json", F.lit("[]")),
    }).alias("json"))


def offsets(samples: DataFrame, sample_rate: int, cfg: DcConfig = DcConfig()) -> DataFrame:
    """(track, json) of the DC analysis."""
    rows = dc.channels(samples, sample_rate).join(dc.patterns(samples, sample_rate, cfg), ["track", "channel"])
    high = F.when(F.col("pattern") == "drifting", 20.0).otherwise(5.0)
    channel = record({
        "offsetLinear": number(F.col("dc")), "offsetDbfs": number(F.col("dc_dbfs")), "offsetPercent": number(F.col("percent")), "pattern": text(F.col("pattern")), "minWindowOffset": number(F.col("min_window")), "maxWindowOffset": number(F.col("max_window")),
        "headroomLostDb": number(F.col("headroom_db")), "peakAfterCorrectionDbfs": number(db(F.col("corrected_peak"))), "recommendedHighpassHz": number(F.when(F.col("pattern") != "none", high).otherwise(0.0)), "stepLocations": items(F.transform("step_frames", lambda s: s.cast("string"))),
    })
    channels = _listed(rows, "track", ["channel"], channel, "channels")
    any_ = rows.groupBy("track").agg(F.bool_or(F.col("pattern") != "none").alias("any"), F.count("*").alias("n"))
    series = dc.series(samples, sample_rate).groupBy("track").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "channel", "mean"))), lambda s: s["mean"]).alias("series"))
    return any_.join(channels, "track").join(series, "track").select("track", record({
        "schemaVersion": F.lit(VERSION), "significanceThresholdDbfs": number(cfg.threshold_db), "anySignificant": flag(F.col("any")), "windowSeconds": number(1.0), "channels": F.col("channels"),
        "windowSeriesChannelCount": whole(F.col("n")), "windowSeries": numbers(F.col("series")),
    }).alias("json"))


def beats(found: BeatAnalysis, hop_s: float) -> DataFrame:
    """(track, json) of analyze_beats; bars are -1 where no downbeat is known."""
    onsets = _listed(found.onsets, "track", ["at"], record({"timeSeconds": number(F.col("at")), "strength": number(F.col("strength")), "bandMask": whole(F.col("band_mask"))}), "onsets")
    bar = F.col("bar_beat") if "bar_beat" in found.beats.columns else F.lit(-1)
    beats_ = _listed(found.beats, "track", ["at"], record({"timeSeconds": number(F.col("at")), "confidence": number(F.col("confidence")), "beatIndexInBar": whole(bar)}), "beats")
    others = _listed(found.alternatives, "track", ["rank"], record({"bpm": number(F.col("bpm")), "score": number(F.col("score"))}), "alternatives")
    out = found.tempo.join(onsets, "track", "left").join(beats_, "track", "left").join(others, "track", "left")
    empty = lambda c: F.coalesce(c, F.lit("[]"))
    return out.select("track", record({
        "schemaVersion": F.lit(VERSION), "primaryBpm": number(F.col("bpm")), "tempoConfidence": number(F.col("confidence")), "phaseConfidence": number(F.col("phase_confidence")), "tempoIsStable": flag(F.col("stable")), "odfHopSeconds": number(hop_s),
        "alternatives": empty("alternatives"), "onsets": empty("onsets"), "beats": empty("beats"),
    }).alias("json"))


#: The classes in the order of the report's counts
REPORT_CLASSES = ("kick", "snare", "hihat", "percussion", "tonal_onset", "click", "dropout", "unclassified")


def transients(found: DataFrame, sample_rate: int) -> DataFrame:
    """(track, json) of analyze_transients: musical transients and defects."""
    shares = items(F.array(*[number(F.coalesce(c, F.lit(0.0))) for c in ("share_low", "share_lowmid", "share_highmid", "share_high")]))
    zero = lambda c: number(F.coalesce(c, F.lit(0.0)))
    row = record({
        "startSeconds": number(F.col("start") / sample_rate), "attackSeconds": number(F.col("attack") / sample_rate), "classification": text(F.col("class")), "classConfidence": number(F.col("confidence")), "strength": number(F.col("strength")), "peakDbfs": number(F.col("peak_dbfs")),
        "attackTimeMs": zero("attack_ms"), "decayTimeMs": zero("decay_ms"), "spectralCentroidHz": zero("centroid"), "spectralFlatness": zero("flatness"), "bandEnergyRatio": shares,
    })
    defect = F.col("class").isin("click", "dropout")
    musical = _listed(found.where(~defect), "track", ["attack", "class"], row, "transients")
    defects = _listed(found.where(defect), "track", ["class", "attack"], row, "defects")
    counts = found.groupBy("track").agg(items(F.array(*[F.count(F.when(F.col("class") == c, 1)).cast("string") for c in REPORT_CLASSES])).alias("counts"))
    out = counts.join(musical, "track", "left").join(defects, "track", "left")
    return out.select("track", record({"schemaVersion": F.lit(VERSION), "countByClass": F.col("counts"), "transients": F.coalesce("transients", F.lit("[]")), "defects": F.coalesce("defects", F.lit("[]"))}).alias("json"))


def metadata(tags: DataFrame, fields: list[str]) -> DataFrame:
    """(file, json) from merged tags (file, field, value, source): the fields, null where a file has none, and where each came from."""
    maps = tags.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("v"), F.map_from_entries(F.collect_list(F.struct("field", "source"))).alias("s"))
    sources = items(F.filter(F.array(*[F.when(F.try_element_at("s", F.lit(f)).isNotNull(), record({"field": text(f), "origin": text(F.try_element_at("s", F.lit(f)))})) for f in fields]), lambda x: x.isNotNull()))
    return maps.select("file", record({"schemaVersion": F.lit(VERSION), **{f: text(F.try_element_at("v", F.lit(f))) for f in fields}, "sources": sources}).alias("json"))
