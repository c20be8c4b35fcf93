"""Access rules over ledgers of events: epochs, time locks, fuses, heartbeats, roles, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.model import LOCK_FLAGS


def epoch(at: Column, origin: Column, length: int) -> Column:
    """Number of whole lengths since the origin, never below 0. Seconds."""
    return F.greatest(F.lit(0), F.floor((at - origin) / length)).cast("long")


def access(now: Column, valid_from: Column, valid_until: Column, remaining: Column) -> Column:
    """Decision in the order of the rules: too early, expired (the last epoch is still valid), used up, open. Null bounds don't bind."""
    return F.when(now < valid_from, "delayed").when(now > valid_until, "expired").when(remaining <= 0, "exhausted").otherwise("open")


def in_window(now: Column, issued: Column, window: int) -> Column:
    return now.between(issued, issued + window)


def consume(events: DataFrame, key: str, fuses: int, *order: str) -> DataFrame:
    """events with use (their place from 1), granted and remaining after them: the first `fuses` events of a key are granted."""
    use = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("use", use).withColumn("granted", F.col("use") <= fuses).withColumn("remaining", F.greatest(F.lit(0), fuses - F.col("use")))


def heartbeats(events: DataFrame, key: str, *order: str) -> DataFrame:
    """events with beat: whether their epoch is beyond the last event's."""
    before = F.lag("epoch").over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("beat", F.col("epoch") > F.coalesce(before, F.lit(-1)))


def visible(entries: DataFrame, level: int) -> DataFrame:
    """Entries that a role of a level reaches: its own level's and those of higher numbers."""
    return entries.where(F.col("role_level") >= level)


def claims(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The first event of each key, which claims it."""
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order)).alias("x")).select(key, "x.*")


def flags(of: Column) -> list[Column]:
    return [((of.bitwiseAND(bit)) != 0).alias(name) for name, bit in LOCK_FLAGS.items()]


def label(bits: Column, sections: Column, ledger_rows: Column, unlocked: Column) -> Column:
    """Words that describe a locked file: one for its kind, then its modifiers in a fixed order. sections: names of its trailer sections."""
    has = lambda name: F.array_contains(sections, name)
    on = lambda name: bits.bitwiseAND(LOCK_FLAGS[name]) != 0
    kind = F.when(has("ARCV") & has("PKEY"), "app").when(has("ARCV"), "archive").when(has("PART"), "parted").when(unlocked, "unlocked").otherwise("file")
    said = [(on("fused"), "fused"), (has("FBOX"), "fbox"), (ledger_rows > 0, "ledger"), (has("TOTP"), "totp"), (has("ENGR"), "engraved"), (has("CLAM"), "claimable")]
    said += [(on(name), name) for name in ("keychain", "purge", "timed", "delayed")]
    return F.concat_ws(" ", kind, *[F.when(when, word) for when, word in said])
