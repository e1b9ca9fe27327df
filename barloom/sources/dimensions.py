"""Fixed lookup tables of the domain: holidays, sectors, identifiers. All values are fixed by the market."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Exchange holidays.
HOLIDAYS = {
    "2024-01-26": "Republic Day",
    "2024-03-08": "Mahashivratri",
    "2024-03-25": "Holi",
    "2024-03-29": "Good Friday",
    "2024-04-11": "Eid-ul-Fitr",
    "2024-04-17": "Ram Navami",
    "2024-05-01": "Maharashtra Day",
    "2024-05-20": "General Election (Mumbai)",
    "2024-06-17": "Bakri Eid",
    "2024-07-17": "Muharram",
    "2024-08-15": "Independence Day",
    "2024-10-02": "Gandhi Jayanti",
    "2024-11-01": "Diwali Laxmi Pujan",
    "2024-11-15": "Guru Nanak Jayanti",
    "2024-12-25": "Christmas",
    "2025-02-26": "Mahashivratri",
    "2025-03-14": "Holi",
    "2025-03-31": "Eid-ul-Fitr",
    "2025-04-10": "Mahavir Jayanti",
    "2025-04-14": "Dr. Ambedkar Jayanti",
    "2025-04-18": "Good Friday",
    "2025-05-01": "Maharashtra Day",
    "2025-08-15": "Independence Day",
    "2025-08-27": "Ganesh Chaturthi",
    "2025-10-02": "Gandhi Jayanti",
    "2025-10-21": "Diwali Laxmi Pujan",
    "2025-10-22": "Govardhan Puja",
    "2025-11-05": "Guru Nanak Jayanti",
    "2025-12-25": "Christmas",
    "2026-01-26": "Republic Day",
    "2026-02-17": "Mahashivratri",
    "2026-03-04": "Holi",
    "2026-03-21": "Eid-ul-Fitr",
    "2026-04-03": "Good Friday",
    "2026-04-14": "Dr. Ambedkar Jayanti",
    "2026-05-01": "Maharashtra Day",
    "2026-08-14": "Independence Day (observed)",
    "2026-10-02": "Gandhi Jayanti",
    "2026-11-09": "Diwali Laxmi Pujan",
    "2026-11-24": "Guru Nanak Jayanti",
    "2026-12-25": "Christmas",
}

# Security identification number -> exchange symbol.
ISINS = {
    "INE002A01018": "RELIANCE",
    "INE467B01029": "TCS",
    "INE009A01021": "INFY",
    "INE040A01034": "HDFCBANK",
    "INE090A01021": "ICICIBANK",
    "INE062A01020": "SBIN",
    "INE154A01025": "ITC",
    "INE397D01024": "BHARTIARTL",
    "INE030A01027": "HINDUNILVR",
    "INE237A01028": "KOTAKBANK",
    "INE238A01034": "AXISBANK",
    "INE267A01025": "HINDZINC",
    "INE155A01022": "TMPV",
    "INE1TAE01010": "TMCV",
    "INE976I01016": "TATACAP",
    "INF204KB17I5": "GOLDBEES",
    "INF204KC1402": "SILVERBEES",
    "INF109KC1NT3": "GOLDIETF",
    "INF109KC1Y56": "SILVERIETF",
    "INF277KA1984": "TATSILV",
}


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(date.fromisoformat(d), name) for d, name in HOLIDAYS.items()], "date date, holiday string"
    )


def isins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"{s}.NS") for i, s in ISINS.items()], "isin string, symbol string")
