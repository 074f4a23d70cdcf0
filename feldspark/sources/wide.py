"""A made-up table of the canonical schema's full width: 434 columns, as many rows as asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import roles

#: Columns of a block that are missing in the same rows, and shares of rows in which blocks are missing.
BLOCK, MISSING = 12, (0.0, 0.02, 0.12, 0.28, 0.45, 0.6, 0.76, 0.86, 0.93)


def _uniform(row: Column, name: str) -> Column:
    """Evenly spread values in [0, 1) that depend on the row and a name alone."""
    return F.pmod(F.xxhash64(row, F.lit(name)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def transactions(spark: SparkSession, n: int) -> DataFrame:
    """n rows: heavy tails, many equal values, a few groups of columns that say nearly the same, missing values in blocks."""
    row = F.col("id")
    u = lambda name: _uniform(row, name)
    pick = lambda name, values: F.element_at(F.array(*map(F.lit, values)), (F.floor(u(name) * len(values)) + 1).cast("int"))
    card = F.floor(F.pow(u("card"), F.lit(3.0)) * 13_000)
    by_card = lambda name, k: F.pmod(F.xxhash64(card, F.lit(name)), F.lit(k)).cast("float")
    amount = F.round(F.exp(u("amount") * 4 + u("amount2") * 3), 2)
    columns: dict[str, Column] = {
        "TransactionID": (row + 2_987_000).cast("int"), "TransactionDT": (row * 26 + F.floor(u("dt") * 26)).cast("long"), "isFraud": (u("y") < F.lit(0.02) + F.lit(0.03) * (amount > 300).cast("int")).cast("tinyint"), "TransactionAmt": amount.cast("float"),
        "ProductCD": pick("product", "WCRHS"), "card1": card.cast("float"), "card2": by_card("card2", 500), "card3": by_card("card3", 110), "card4": pick("card4", ("visa", "mastercard", "discover", "american express")), "card5": by_card("card5", 119),
        "card6": pick("card6", ("debit", "credit")), "addr1": by_card("addr1", 330), "addr2": by_card("addr2", 70), "dist1": F.floor(F.exp(u("dist1") * 8)).cast("float"), "dist2": F.floor(F.exp(u("dist2") * 8)).cast("float"),
        "P_emaildomain": pick("p", [f"{c}.example" for c in "abcdefghijklmnop"]), "R_emaildomain": pick("r", [f"{c}.example" for c in "abcdefghijklmnop"]),
    }
    numbers = [f"C{i}" for i in range(1, 15)] + [f"D{i}" for i in range(1, 16)] + [f"V{i}" for i in range(1, 340)] + [f"id_{i:02}" for i in range(1, 12)]
    for k, c in enumerate(numbers):
        # every fourth column says nearly the same as the one before it
        source = numbers[k - 1] if k % 4 == 3 else c
        value = F.floor(F.exp(u(source) * (3 + k % 5))) if k % 3 else F.round(u(source) * 50 * (1 + k % 7), 3)
        columns[c] = (value + (F.floor(u(c) * 1.02) if source != c else F.lit(0))).cast("float")
    for i in range(1, 10):
        columns[f"M{i}"] = pick(f"M{i}", ("M0", "M1", "M2") if i == 4 else ("T", "F"))
    for c in (f"id_{i}" for i in range(12, 39)):
        columns[c] = pick(c, [f"{c}-{v}" for v in range(2 + int(c[3:]) % 9)])
    columns |= {"DeviceType": pick("device", ("mobile", "desktop")), "DeviceInfo": F.concat(F.lit("Device "), F.floor(F.pow(u("info"), F.lit(4.0)) * 1700).cast("int"))}
    whole = {*roles.META, "TransactionAmt", "ProductCD", "card1", *(f"C{i}" for i in range(1, 15))}
    holes = lambda k: F.lit(MISSING[(k // BLOCK) % len(MISSING)])
    made = [(e if c in whole else F.when(u(f"hole{k // BLOCK}") >= holes(k), e)).alias(c) for k, (c, e) in enumerate(columns.items())]
    return spark.range(n).select(*made)
