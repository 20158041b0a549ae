"""Instants as text: ISO in UTC, display in a zone, folders and file names by time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso(at: Column) -> Column:
    """An instant (timestamp without zone, in UTC) as ISO text with its offset; microseconds only where there are some."""
    micros = F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000))
    part = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def parsed(text: Column) -> Column:
    """Text as an instant in UTC; without offset it is in UTC already, null if it can't be read."""
    return F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.try_to_timestamp(F.regexp_replace(text, "[Zz]$", "+00:00")).cast("timestamp_ntz"))


def utc_iso(text: Column) -> Column:
    """Text of a time as ISO in UTC; what can't be read stays as it is."""
    return F.coalesce(iso(parsed(text)), text)


def displayed(text: Column, zone: str = "UTC") -> Column:
    """Text of a time as shown to readers in a zone, with the zone's name; a dash for none, what can't be read stays."""
    local = F.from_utc_timestamp(parsed(text).cast("timestamp"), zone)
    offset = F.unix_seconds(local) - F.unix_seconds(parsed(text).cast("timestamp"))
    name = F.when(offset == 9 * 3600, "JST").when(offset == 0, "UTC").otherwise(F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(offset) / 3600).cast("string"), 2, "0")))
    shown = F.concat(F.date_format(local, "yyyy/MM/dd HH:mm:ss"), F.lit(" "), name)
    return F.when(F.coalesce(text, F.lit("")) == "", "-").otherwise(F.coalesce(shown, text))


def frame_path(at: Column, session_id: Column, root: str = "frames") -> Column:
    """Where a frame of an instant is stored: a folder by day, a name by time and session."""
    micros = F.lpad(F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(F.lit(f"{root}/"), F.date_format(at, "yyyy-MM-dd/HHmmss"), F.lit("-"), micros, F.lit("-"), F.substring(session_id, 1, 8), F.lit(".webp"))
