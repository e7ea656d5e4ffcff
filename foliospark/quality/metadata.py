"""What a target asks for that tables do not have yet, by their schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from foliospark.quality.evolution import Change, Target, pending

def pending_tables(tables: Mapping[str, DataFrame], targets: Mapping[str, Target], dropped: tuple[str, ...] = ()) -> dict[str, list[Change]]:
    """By table what is pending: ``create`` for one that is missing, ``remove`` for one to be dropped, else its columns' changes."""
    out = {name: pending(tables[name].schema, t) if name in tables else [Change("create", name)] for name, t in targets.items()}
    out |= {name: [Change("remove", name)] for name in dropped if name in tables}
    return {name: changes for name, changes in out.items() if changes}


def applied_tables(tables: Mapping[str, DataFrame], targets: Mapping[str, Target], dropped: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables as the targets want them; missing ones are empty. Applying twice is applying once."""
    from foliospark.quality.evolution import applied

    spark = next(iter(tables.values())).sparkSession
    out = {name: t for name, t in tables.items() if name not in dropped}
    for name, target in targets.items():
        empty = spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, kind in target.columns.items()))
        out[name] = applied(out[name], target) if name in out else empty
    return out


def verified(tables: Mapping[str, DataFrame], targets: Mapping[str, Target], dropped: tuple[str, ...] = ()) -> None:
    """An error if anything is still pending."""
    left = pending_tables(tables, targets, dropped)
    if left:
        raise ValueError(f"pending: {left}")
