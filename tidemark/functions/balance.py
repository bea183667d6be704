"""Balance of a bidirectional locus from the signal downstream (PD, MD) and upstream (PU, MU) on either strand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def balance_bc(pd: Column, md: Column, pu: Column, mu: Column) -> Column:
    """Bhattacharyya coefficient with a perfect locus (half on PD, half on MD); 0 without signal."""
    total = pd + md + pu + mu
    return F.when(total == 0, 0.0).otherwise(F.sqrt(0.5 * pd / total) + F.sqrt(0.5 * md / total))


def balance_d(pd: Column, md: Column, pu: Column, mu: Column) -> Column:
    """One minus the directionality of the downstream signal, from 0 to 1; 0 without signal."""
    total = pd + md
    return F.when(total == 0, 0.0).otherwise(F.abs(F.abs((pd - md) / total) - 1.0))
