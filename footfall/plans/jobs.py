"""The end-to-end jobs: sightings and dimensions in, result table out.

All sites are computed in one Spark job. Publishing a result is a call of a
writer in `footfall.sinks`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators import flow, sessions, signal, stats, traffic, visits
from footfall.operators.clean import filter_day, filter_rssi, keep_known_vendors, with_load_time, with_site
from footfall.schema import LOCAL_ZONE, VISIT_GAP


def realtime_traffic(s: DataFrame, ap_dim: DataFrame, window: str = "5 minutes",
                     mon_time: int | None = None) -> DataFrame:
    """Distinct visitors of every site in its latest window."""
    s = with_site(filter_rssi(s), ap_dim, unknown="drop")
    latest = traffic.latest_window(traffic.traffic_per_window(s, window))
    return with_load_time(latest.select("site_id", F.col("traffic").alias("value")), mon_time)


def traffic_today(s: DataFrame, ap_dim: DataFrame, day: str, tz: str = LOCAL_ZONE,
                  mon_time: int | None = None) -> DataFrame:
    """Distinct visitors of every site on one local day."""
    s = with_site(filter_rssi(filter_day(s, day, tz)), ap_dim, unknown="drop")
    value = s.groupBy("site_id").agg(F.count_distinct("device").alias("value"))
    return with_load_time(value, mon_time)


def people_on_site(s: DataFrame, ap_dim: DataFrame, origin: int, every: int, ticks, seconds: int,
                   policy: str = "first_visit", mon_time: int | None = None) -> DataFrame:
    """Open visits of every site after the given ticks."""
    s = with_site(filter_rssi(s), ap_dim, unknown="drop")
    found = visits.visit_tracker(s, origin, every, ticks, seconds, policy)
    value = visits.open_visits(found).select("site_id", F.col("open").alias("value"))
    return with_load_time(value, mon_time)


def entry_exit_report(s: DataFrame, ap_dim: DataFrame, static_devices: DataFrame | None = None,
                      day: str | None = None, window: str | None = "5 minutes", tz: str = LOCAL_ZONE) -> DataFrame:
    """Entries, exits and net flow per site, per window unless window is None."""
    if day is not None:
        s = filter_day(s, day, tz)
    moves = flow.side_moves(signal.trajectory(s, ap_dim, static_devices))
    return flow.net_flow(flow.come_go_counts(moves, window))


def occupancy_report(s: DataFrame, ap_dim: DataFrame, static_devices: DataFrame | None = None,
                     window: str = "5 minutes", base: DataFrame | None = None) -> DataFrame:
    """Running number of people per site and window."""
    return flow.occupancy(entry_exit_report(s, ap_dim, static_devices, window=window), base)


def peak_instants(s: DataFrame, ap_dim: DataFrame, keys=("device", "ts")) -> DataFrame:
    """Interior peaks of the cleaned means, one row per device and instant."""
    peaks = signal.rssi_peaks(signal.mean_rssi(filter_rssi(s)), endpoints=False)
    return signal.inside_wins(with_site(peaks, ap_dim), keys)


def visit_flow(s: DataFrame, ap_dim: DataFrame, gap: int = VISIT_GAP, tz: str = LOCAL_ZONE) -> DataFrame:
    """Come - go + stay per five minutes of the local day, from classified visits."""
    return sessions.flow_by_bucket(sessions.classify_visits(peak_instants(s, ap_dim), gap), tz)


def static_device_update(s: DataFrame, stored: DataFrame, hours: int = 24, tz: str = LOCAL_ZONE) -> DataFrame:
    """Stored always-on devices plus those of the given sightings."""
    return traffic.merge_static_devices(stored, traffic.always_on_devices(s, hours, tz=tz))


def vendor_profile(s: DataFrame, oui: DataFrame) -> DataFrame:
    """Kurtosis of the signal per device and access point, known vendors only."""
    return stats.rssi_kurtosis(keep_known_vendors(s, oui))
