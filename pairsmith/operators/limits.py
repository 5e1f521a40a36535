"""Rate limits and numbers of workers as columns: for tables of models, providers or experiments, in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bucket(rpm: Column, burst: Column) -> Column:
    return F.struct((rpm.cast("double") / 60).alias("rate"), burst.cast("long").alias("burst"))


def model_bucket(rpm: Column) -> Column:
    """struct(rate, burst): tokens a second and at once, of a model's limit a minute."""
    return _bucket(rpm, F.greatest(F.lit(5), F.floor(rpm / 5)))


def provider_bucket(rpm: Column, percent: Column) -> Column:
    """struct(rate, burst) of a limit that all models of a provider share."""
    return _bucket(rpm, F.greatest(F.lit(3), F.floor(rpm * percent / 100)))


def in_force(model_rpm: Column, provider_rpm: Column, percent: Column) -> Column:
    """The bucket that a call waits for: the provider's, where it has a limit, before the model's."""
    return F.when(provider_rpm.isNotNull(), provider_bucket(provider_rpm, percent)).otherwise(model_bucket(model_rpm))


def effective_rate(model_rpm: Column, provider_rpm: Column, percent: Column) -> Column:
    """How many requests may be under way at once."""
    shared = F.greatest(F.lit(3), F.floor(provider_rpm * (percent + 100) / 100))
    return F.when(provider_rpm.isNotNull(), shared).otherwise(F.greatest(F.lit(5), F.floor(model_rpm / 5))).cast("long")


def workers(jobs: Column, rate: Column, concurrency: Column) -> Column:
    """No more workers than there are jobs, than the limits let through, and than are asked for; one at least."""
    return F.greatest(F.least(jobs, rate, concurrency), F.lit(1)).cast("long")
