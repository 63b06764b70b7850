"""Patent analytics on Spark: raw feeds -> clean star -> checked star -> reports."""

from grantstar.plans.clean import clean
from grantstar.plans.quality import quality_check
from grantstar.schemas import Feeds, Star
from grantstar.session import build_session, tune

__all__ = ["Feeds", "Star", "build_session", "clean", "quality_check", "tune"]
