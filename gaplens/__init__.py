"""gaplens: a PySpark-native engine for auditing and imputing missing data."""

from .functions.stats import pool_rubin
from .operators.chained import ChainedImputer, pool_means
from .operators.evidence import little_mcar, structural_pairs
from .operators.impute import Fitted, PlanImputer, Step, fill, violations
from .operators.profile import profile, summary
from .operators.sensitivity import tipping as mnar_sensitivity
from .operators.sensitivity import trajectory as mnar_trajectory
from .plans.audit import Audit, mechanism, recommend
from .plans.report import report_md
from .plans.rules import leakage_findings, make_plan
from .plans.script import emit_script

__version__ = "0.1.0"
__all__ = [
    "Audit", "ChainedImputer", "Fitted", "PlanImputer", "Step", "emit_script", "fill", "leakage_findings", "little_mcar", "make_plan", "mechanism", "mnar_sensitivity",
    "mnar_trajectory", "pool_means", "pool_rubin", "profile", "recommend", "report_md", "structural_pairs", "summary", "violations",
]
