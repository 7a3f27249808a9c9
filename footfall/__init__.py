"""People-flow analytics over Wi-Fi probe sightings, on PySpark.

Operators take and return DataFrames, so they chain with `df.transform`.
The canonical sightings columns are

    device STRING, ap STRING, rssi DOUBLE, ts BIGINT (epoch seconds)

plus `seq BIGINT` where the wire format carries one, and `site_id INT`,
`side STRING` once the access-point dimension has been attached.
Key columns are non-null: `sources.scans.parse_lines` sends lines without a
device, time or access point to quarantine.
"""
