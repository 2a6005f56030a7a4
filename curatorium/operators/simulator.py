"""The grant simulator: subsidies of three frames from costs in units of ten thousand yen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(soft: Column, high: Column, special: Column) -> dict[str, Column]:
    """Normal frame: half, or two thirds, of the cost, up to the limit of the number of processes."""
    raw = soft * F.when(special, F.lit(2.0) / 3).otherwise(0.5)
    granted = F.least(raw, F.when(high, 4_500_000.0).otherwise(1_499_999.0))
    under = (raw > 0) & (raw < 50_000) | high & (raw > 0) & (raw < 1_500_000)
    return _result(soft, F.lit(0.0), F.lit(0.0), granted, F.lit(0.0), F.lit(0.0), under)


def invoice(soft: Column, pc: Column, register: Column, small: Column, one_feature: Column) -> dict[str, Column]:
    """Invoice frame: a higher rate up to 500,000 yen of subsidy and two thirds beyond; half of the hardware up to its limits."""
    low = F.when(soft <= 625_000, soft * 0.8).otherwise(500_000 + (soft - 625_000) * (F.lit(2.0) / 3))
    high = F.when(soft <= 666_666, soft * 0.75).otherwise(500_000 + (soft - 666_666) * (F.lit(2.0) / 3))
    granted = F.least(F.when(small, low).otherwise(high), F.when(one_feature, 500_000.0).otherwise(3_500_000.0))
    return _result(soft, pc, register, granted, F.least(pc * 0.5, F.lit(100_000.0)), F.least(register * 0.5, F.lit(200_000.0)), F.lit(False))


def electronic(soft: Column, small_or_medium: Column) -> dict[str, Column]:
    """Electronic-trade frame: two thirds for small and medium firms, half for others, up to 3,500,000 yen."""
    granted = F.least(soft * F.when(small_or_medium, F.lit(2.0) / 3).otherwise(0.5), F.lit(3_500_000.0))
    return _result(soft, F.lit(0.0), F.lit(0.0), granted, F.lit(0.0), F.lit(0.0), F.lit(False))


def _result(soft, pc, register, granted, granted_pc, granted_register, under) -> dict[str, Column]:
    cost = soft + pc + register
    total = F.floor(granted + granted_pc + granted_register)
    return {"total_cost": cost, "total_subsidy": total, "self_pay": F.greatest(cost - total, F.lit(0.0)), "subsidy_soft": F.floor(granted), "subsidy_pc": F.floor(granted_pc), "subsidy_register": F.floor(granted_register), "under_limit": under}
