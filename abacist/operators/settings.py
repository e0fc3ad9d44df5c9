"""Payment gateway settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def public_settings(settings: DataFrame, gateway: str | None = None) -> DataFrame:
    """Settings without their secrets, of all gateways or one; an unknown gateway gives no row."""
    chosen = settings if gateway is None else settings.filter(F.col("gateway") == gateway)
    return chosen.select("gateway", "merchant_id", "qr_code_url", "is_active", "updated_at")
