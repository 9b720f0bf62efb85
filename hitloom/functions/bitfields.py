"""Bit-field layouts of cell ids as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layouts that landed cell ids use, lowest bit first
LAYOUTS = {
    "SiTarget": "system:8,layer:8,slice:4,plane:1,column:2,row:2,strip:14",
    "SiPad": "system:8,layer:8,slice:4,x:9,y:9",
    "MTC": "system:8,station:2,layer:8,slice:4,plane:2,strip:14,x:9,y:9",
}


def parse(spec: str) -> list[tuple[str, int, int, bool]]:
    """Name, offset, width and signedness of each field.

    A field is name:width or name:offset:width; a negative width marks a signed field.
    """
    out, at = [], 0
    for part in spec.split(","):
        name, *numbers = part.strip().split(":")
        if len(numbers) not in (1, 2):
            raise ValueError(f"field {part!r} is neither name:width nor name:offset:width")
        width = int(numbers[-1])
        at = int(numbers[0]) if len(numbers) == 2 else at
        if not width or at + abs(width) > 64:
            raise ValueError(f"field {part!r} doesn't fit in 64 bits")
        out.append((name, at, abs(width), width < 0))
        at += abs(width)
    return out


def field(cell: Column, offset: int, width: int, signed: bool = False) -> Column:
    value = F.shiftrightunsigned(cell, offset).bitwiseAND(F.lit((1 << width) - 1))
    return F.when(value >= 1 << (width - 1), value - (1 << width)).otherwise(value) if signed else value


def decode(df: DataFrame, spec: str, col: str = "cell_id", prefix: str = "bf_") -> DataFrame:
    """df with an int column for every field of the layout."""
    return df.withColumns({prefix + name: field(F.col(col), at, width, signed).cast("int") for name, at, width, signed in parse(spec)})


def decode_all(df: DataFrame, layouts: dict[str, str], by: str = "detector", col: str = "cell_id", prefix: str = "bf_") -> DataFrame:
    """df with an int column for every field of any layout, by each row's own one; null where that lacks the field, or there is none."""
    parsed = {d: {n: rest for n, *rest in parse(spec)} for d, spec in layouts.items()}
    out: dict[str, Column] = {}
    for name in dict.fromkeys(n for fields in parsed.values() for n in fields):
        cases = [F.when(F.col(by) == d, field(F.col(col), *fields[name])) for d, fields in parsed.items() if name in fields]
        out[prefix + name] = F.coalesce(*cases).cast("int")
    return df.withColumns(out)


def get(spec: str, name: str, cell: Column) -> Column:
    """One field, 0 where the layout has none of that name."""
    found = {n: rest for n, *rest in parse(spec)}
    return field(cell, *found[name]).cast("int") if name in found else F.lit(0)


def encode(spec: str, values: dict[str, Column]) -> Column:
    """A cell id of the given fields; those not given are 0."""
    out = F.lit(0).cast("long")
    for name, at, width, _ in parse(spec):
        if name in values:
            out = out.bitwiseOR(F.shiftleft(values[name].cast("long").bitwiseAND(F.lit((1 << width) - 1)), at))
    return out


def route(df: DataFrame, cell: str = "cell_id", detector: str = "detector", plane_offset: int = 22) -> DataFrame:
    """MTC rows go to SciFi (plane 0, 1) or Scint (any other plane)."""
    plane = field(F.col(cell), plane_offset, 2)
    return df.withColumn(detector, F.when(F.col(detector) != "MTC", F.col(detector)).when(plane < 2, "SciFi").otherwise("Scint"))
