"""Profile, validate and describe any Spark DataFrame at scale."""

from tablescope.plans.dataset import Report, profile_dataset
from tablescope.plans.quick import QuickReport, quick_profile

__all__ = ["Report", "QuickReport", "profile_dataset", "quick_profile"]
